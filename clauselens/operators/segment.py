"""Documents into lines, headings, blocks, sentences and addressable clauses.

Window functions run within one document, whose lines are its natural bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation_text, formatting_reason, sentences


def lines(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, line_no, line): exact line numbers from 0; a null text has none."""
    return docs.select(F.col(id).alias("id"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))


def marked_lines(rows: DataFrame) -> DataFrame:
    """lines() with fenced, heading level and title; headings inside fences don't count."""
    w = Window.partitionBy("id").orderBy("line_no")
    fence = F.col("line").rlike(r"^\s*(?:```|~~~)")
    out = rows.withColumn("fences", F.sum(fence.cast("int")).over(w))
    inside = (F.col("fences") % 2 == 1) | fence
    head = F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*$", 1)
    level = F.when(~inside & (head != ""), F.length(head))
    return out.select("id", "line_no", "line", inside.alias("fenced"), level.alias("level"), F.when(level.isNotNull(), F.regexp_extract("line", r"^(#{1,6})\s+(.*?)\s*#*$", 2)).alias("title"))


def sections(rows: DataFrame) -> DataFrame:
    """(id, section, level, title, anchor, path, start, end) of marked_lines(); what stands before the first heading is section 0 without title."""
    w = Window.partitionBy("id").orderBy("line_no")
    s = rows.withColumn("section", F.sum(F.col("level").isNotNull().cast("int")).over(w))
    g = s.groupBy("id", "section").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end"), F.max("level").alias("level"), F.max("title").alias("title"))
    up = Window.partitionBy("id").orderBy("section")
    last = g
    for k in range(1, 7):  # the last heading of each level, forgotten at a higher one
        last = last.withColumn(f"_h{k}", F.last(F.when(F.col("level") <= k, F.struct("level", "title")), True).over(up))
    path = F.array_compact(F.array(*(F.when((F.col(f"_h{k}.level") == k) & (F.lit(k) <= F.col("level")), F.col(f"_h{k}.title")) for k in range(1, 7))))
    anchor = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^a-z0-9 -]", ""), " +", "-")
    return last.select("id", "section", "level", "title", anchor.alias("anchor"), path.alias("path"), "start", "end")


def blocks(rows: DataFrame) -> DataFrame:
    """(id, block, kind, start, text): paragraphs, list items and fenced blocks of marked_lines().

    A block ends at a blank line, a list item, a heading or a fence's edge; a fence is one block with its blank lines.
    """
    w = Window.partitionBy("id").orderBy("line_no")
    item = F.col("line").rlike(r"^\s*(?:[-*+]|\d+[.)])\s+")
    was = F.lag("fenced", 1, False).over(w)
    blank = (F.trim("line") == "") & ~F.col("fenced")
    starts = F.when(F.col("fenced"), ~was).otherwise(was | item | F.col("level").isNotNull() | F.coalesce(F.lag(blank | F.col("level").isNotNull()).over(w), F.lit(True)))
    kind = F.when(F.col("fenced"), "fence").when(F.col("level").isNotNull(), "heading").when(item, "list_item").otherwise("paragraph")
    m = rows.withColumns({"blank": blank, "s": starts, "kind": kind}).withColumn("block", F.sum((F.col("s") & ~F.col("blank")).cast("int")).over(w)).where("not blank")
    g = m.groupBy("id", "block").agg(F.min(F.struct("line_no", "kind")).alias("f"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return g.select("id", "block", F.col("f.kind").alias("kind"), F.col("f.line_no").alias("start"), "text")


def clauses(found: DataFrame) -> DataFrame:
    """blocks() other than headings as clauses: name c0001 and on within a document, in order."""
    w = Window.partitionBy("id").orderBy("block")
    return found.where("kind <> 'heading'").withColumn("n", F.row_number().over(w)).select("id", F.format_string("c%04d", "n").alias("clause"), "kind", "start", F.col("text").alias("quote"))


def sentence_rows(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, sentence)"""
    return docs.select(F.col(id).alias("id"), F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def accounting(docs: DataFrame, found: DataFrame, rows: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, chars): every character of the texts under a clause kind, a formatting reason or line breaks; buckets sum to the texts.

    docs the texts, found their blocks(), rows their marked_lines().
    """
    block = found.select(F.col("kind").alias("bucket"), (F.length("text") - (F.size(F.split("text", "\n")) - 1)).alias("n"))
    loss = rows.where((F.trim("line") == "") & ~F.col("fenced")).select(F.concat(F.lit("loss: "), F.coalesce(formatting_reason(F.col("line")), F.lit("other"))).alias("bucket"), F.length("line").alias("n"))
    breaks = docs.where(F.col(text).isNotNull()).select(F.lit("loss: line breaks").alias("bucket"), (F.size(F.split(F.col(text), "\n")) - 1).alias("n"))
    return block.union(loss).union(breaks).groupBy("bucket").agg(F.sum("n").cast("bigint").alias("chars"))


def markers(docs: DataFrame, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, marker, sentence): inline markers with the sentence that they stand in."""
    s = sentence_rows(docs, id, text)
    return s.select("id", "pos", F.explode(F.regexp_extract_all("sentence", F.lit(pattern), F.lit(0))).alias("marker"), "sentence")


def span_faults(spans: DataFrame, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Quotes (id, name, quote) that don't stand verbatim in their document, and names used twice: (id, name, fault)."""
    j = spans.join(docs.select(F.col(id).alias("id"), F.col(text).alias("_t")), "id", "left")
    bad = j.where(~F.coalesce(F.col("_t").contains(F.col("quote")), F.lit(False))).select("id", "name", F.lit("not verbatim").alias("fault"))
    twice = spans.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "name", F.lit("duplicate").alias("fault"))
    return bad.union(twice)


def runs_of(rows: DataFrame, key: str, n: str) -> DataFrame:
    """(key, lo, hi): distinct integers as runs of neighbours."""
    d = rows.select(key, n).distinct()
    island = d.withColumn("_i", F.col(n) - F.row_number().over(Window.partitionBy(key).orderBy(n)))
    return island.groupBy(key, "_i").agg(F.min(n).alias("lo"), F.max(n).alias("hi")).drop("_i")


def neighbours(rows: DataFrame, width: int, doc: str = "id", pos: str = "pos", section: str = "section") -> DataFrame:
    """rows with near: places within width in document order that lie in the same section."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(-width, width)
    near = F.collect_list(F.struct(F.col(section).alias("s"), F.col(pos).alias("p"))).over(w)
    return rows.withColumn("_n", near).withColumn("near", F.transform(F.filter("_n", lambda x: (x["s"] == F.col(section)) & (x["p"] != F.col(pos))), lambda x: x["p"])).drop("_n")


def preceding(rows: DataFrame, value: str, doc: str = "id", section: str = "section", pos: str = "pos") -> DataFrame:
    """rows with before: the value of the nearest earlier row of the section."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(doc, section).orderBy(pos)))


def passages(rows: DataFrame, version: str) -> DataFrame:
    """(id, locator, section, pos, text): the content paragraphs under each heading of marked_lines(), normalised, numbered from 1 in their section.

    The locator is version > #anchor or path > ¶pos. A paragraph that only repeats a section's title (a table of contents) is left out;
    numbers count it, as they do in the document.
    """
    parts = sections(rows).where("section > 0")
    body = blocks(rows).where("kind <> 'heading'")
    own = Window.partitionBy("id").orderBy("at", "what")
    marks = parts.select("id", F.col("start").alias("at"), F.lit(0).alias("what"), "section", F.lit(None).cast("string").alias("text"))
    found = marks.unionByName(body.select("id", F.col("start").alias("at"), F.lit(1).alias("what"), F.lit(None).cast("bigint").alias("section"), "text"))
    placed = found.withColumn("section", F.last("section", True).over(own)).where("what = 1 and section is not null")
    numbered = placed.withColumn("pos", F.row_number().over(Window.partitionBy("id", "section").orderBy("at")))
    named = numbered.join(parts.select("id", "section", "anchor", F.array_join("path", " > ").alias("path")), ["id", "section"]).withColumn("text", citation_text(F.col("text"))).where("text <> ''")
    titles = parts.select("id", citation_text(F.col("title")).alias("text")).distinct()
    ref = F.coalesce(F.concat(F.lit("#"), F.nullif(F.col("anchor"), F.lit(""))), F.col("path"))
    where = F.concat(F.lit(version + " > "), ref, F.lit(" > ¶"), F.col("pos").cast("string"))
    return named.join(titles, ["id", "text"], "left_anti").select("id", where.alias("locator"), F.col("path").alias("section"), "pos", "text")
