"""Document graphs: nodes with line spans, needs and provides; comparison, statistics, censuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grammar import parse_name
from .components import clusters
from .joins import BOX, boxes_that_meet, dangling, edge_overlap, edges, interval_overlaps
from .metrics import ratio


def node_kind(claim: Column, provides: Column, needs: Column) -> Column:
    """ordering, definitional (provides and needs nothing), meta, else conditional. provides and needs are arrays."""
    return F.when(claim.rlike(r"(?i)\b(?:before|takes precedence|overrides|outranks)\b"), "ordering").when((F.size(provides) > 0) & (F.size(needs) == 0), "definitional").when(claim.rlike(r"(?i)\bthis (?:document|section|spec)\b"), "meta").otherwise("conditional")


def node_rows(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, quote, kind, line): graph nodes as clause-shaped rows; the quote shows claim, provides, needs and the span's lines.

    nodes (id, claim, provides array, needs array, lo, hi), lines (line_no, line).
    """
    body = nodes.select("id", F.explode(F.sequence("lo", "hi")).alias("line_no")).join(lines, "line_no").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(name + ": "), F.array_join(c, ", ")))
    j = nodes.join(body, "id", "left")
    return j.select("id", F.concat_ws("\n", "claim", part("provides", F.col("provides")), part("needs", F.col("needs")), "body").alias("quote"), node_kind(F.col("claim"), F.col("provides"), F.col("needs")).alias("kind"), F.col("lo").alias("line"))


def strict_edges(e: DataFrame, f: DataFrame, aligned: DataFrame) -> DataFrame:
    """Edges of e (name, needer, provider) whose both ends are aligned (na, nb) with the ends of an edge of f."""
    pairs = e.join(aligned.select(F.col("na").alias("needer"), F.col("nb").alias("_n")), "needer").join(aligned.select(F.col("na").alias("provider"), F.col("nb").alias("_p")), "provider")
    return pairs.join(f.select(F.col("needer").alias("_n"), F.col("provider").alias("_p")).distinct(), ["_n", "_p"], "left_semi").select("name", "needer", "provider").distinct()


def shadowed(e: DataFrame, width: int = 16) -> DataFrame:
    """Edges (id, nlo, nhi, plo, phi) both of whose regions overlap another edge of the same graph; width as in edge_overlap()."""
    boxes = e.groupBy(*BOX).agg(F.count_distinct("id").alias("n"))
    other = " or ".join(f"{c} <> f_{c}" for c in BOX)
    hit = boxes.where("n > 1").select(*BOX).union(boxes_that_meet(boxes, boxes, width).where(other).select(*BOX)).distinct()
    return e.join(hit, BOX, "left_semi")


def alignment_groups(pairs: DataFrame, matched: DataFrame, most: int = 3) -> DataFrame:
    """(kind, na, nbs): splits and joins, two or three ways, of aligned pairs (na, nb) left over by a matching (a, b)."""
    used = matched.select(F.col("a").alias("na"), F.col("b").alias("nb"))
    split = pairs.join(used.select("na"), "na", "left_semi").groupBy("na").agg(F.array_sort(F.collect_set("nb")).alias("others")).where(F.size("others").between(2, most))
    join = pairs.join(used.select("nb"), "nb", "left_semi").groupBy("nb").agg(F.array_sort(F.collect_set("na")).alias("others")).where(F.size("others").between(2, most))
    return split.select(F.lit("split").alias("kind"), F.col("na").alias("node"), "others").union(join.select(F.lit("join"), "nb", "others"))


def compare(e: DataFrame, f: DataFrame) -> DataFrame:
    """One row: edges of both graphs, those of e that overlap one of f (precision) and the other way round (recall)."""
    hit, back = edge_overlap(e, f), edge_overlap(f, e)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = n(e, "a").crossJoin(n(f, "b")).crossJoin(n(hit, "hit")).crossJoin(n(back, "back"))
    return one.select("a", "b", ratio(F.col("hit"), F.col("a")).alias("precision"), ratio(F.col("back"), F.col("b")).alias("recall"))


def dangling_changes(needs_a: DataFrame, provides_a: DataFrame, needs_b: DataFrame, provides_b: DataFrame) -> DataFrame:
    """(name, side): names that dangle in one graph only."""
    a, b = dangling(needs_a, provides_a).select("name"), dangling(needs_b, provides_b).select("name")
    return a.join(b, "name", "left_anti").select("name", F.lit("a").alias("side")).union(b.join(a, "name", "left_anti").select("name", F.lit("b")))


def line_mass(spans: DataFrame, rank: dict[str, int], lines: DataFrame) -> DataFrame:
    """(class, lines, share): each line under the best-ranked class that covers it, or unowned. spans (class, lo, hi), lines (line_no)."""
    order = F.create_map(*(x for k, v in rank.items() for x in (F.lit(k), F.lit(v))))
    own = spans.select("class", F.explode(F.sequence("lo", "hi")).alias("line_no")).groupBy("line_no").agg(F.min(F.struct(order[F.col("class")].alias("r"), "class"))["class"].alias("class"))
    g = lines.select("line_no").join(own, "line_no", "left").groupBy(F.coalesce("class", F.lit("unowned")).alias("class")).agg(F.count(F.lit(1)).alias("lines"))
    return g.crossJoin(lines.agg(F.count(F.lit(1)).alias("n"))).select("class", "lines", (F.col("lines") / F.col("n")).alias("share"))


def graph_statistics(nodes: DataFrame, needs: DataFrame, provides: DataFrame, total_lines: int) -> DataFrame:
    """(measure, value): nodes, bad ranges, span sizes, overlapping and nested pairs, multi-provided and dangling names, covered lines.

    nodes (id, lo, hi) closed ranges, needs and provides (node, name).
    """
    good = nodes.where((F.col("lo") >= 0) & (F.col("hi") >= F.col("lo")) & (F.col("hi") < total_lines))
    iv = good.select("id", F.lit(0).alias("key"), "lo", (F.col("hi") + 1).alias("hi"))
    pairs = interval_overlaps(iv, iv, 200).where("ida < idb")
    side = lambda s: good.select(F.col("id").alias("id" + s), F.col("lo").alias("lo" + s), F.col("hi").alias("hi" + s))
    both = pairs.join(side("a"), "ida").join(side("b"), "idb")
    nested = both.where("(loa <= lob and hib <= hia) or (lob <= loa and hia <= hib)")
    size = F.col("hi") - F.col("lo") + 1
    n = lambda df, name, c=None: df.agg((c if c is not None else F.count(F.lit(1))).cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")
    parts = [
        n(nodes, "nodes"), n(nodes.join(good, "id", "left_anti"), "bad ranges"), n(good, "smallest span", F.min(size)), n(good, "median span", F.percentile(size, 0.5)), n(good, "largest span", F.max(size)),
        n(pairs, "overlapping pairs"), n(nested, "nested pairs"), n(provides.groupBy("name").agg(F.count_distinct("node").alias("k")).where("k > 1"), "multi-provided names"),
        n(dangling(needs, provides), "dangling names"), n(edges(needs, provides), "edges"), n(good.select(F.explode(F.sequence("lo", "hi")).alias("l")).distinct(), "covered lines"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def satisfiability_census(vectors: DataFrame) -> DataFrame:
    """(signature, n, yes, unsat): nodes with equal feature vectors; both verdicts among them can't be satisfied. vectors (node, features..., verdict boolean)."""
    features = sorted(c for c in vectors.columns if c not in ("node", "verdict"))
    key = F.sha2(F.to_json(F.struct(*features)), 256)
    g = vectors.groupBy(key.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("verdict"), 1)).alias("yes"))
    return g.withColumn("unsat", (F.col("yes") > 0) & (F.col("yes") < F.col("n")))


def instability(rows: DataFrame) -> DataFrame:
    """(class, substituted, added, dropped) over pairs of runs of an item: names of a class on one side only, as a swap if both sides have one. rows (run, item, class, name); runs are few."""
    x = rows.select("run", "item", "class", "name").distinct()
    have = x.groupBy("item", "class", "name").agg(F.collect_set("run").alias("in"))
    runs = x.groupBy("item").agg(F.array_sort(F.collect_set("run")).alias("rs"))
    pairs = have.join(runs, "item").select("item", "class", "in", F.explode("rs").alias("a"), "rs").select("item", "class", "in", "a", F.explode("rs").alias("b")).where("a < b")
    left, right = F.array_contains("in", F.col("a")), F.array_contains("in", F.col("b"))
    g = pairs.groupBy("item", "class", "a", "b").agg(F.count(F.when(left & ~right, 1)).alias("l"), F.count(F.when(right & ~left, 1)).alias("r"))
    s = F.least("l", "r")
    return g.groupBy("class").agg(F.sum(s).alias("substituted"), F.sum(F.col("r") - s).alias("added"), F.sum(F.col("l") - s).alias("dropped"))


def span_match(level: str) -> Column:
    """The join condition of candidate atoms (c_*) and reference atoms (r_*) at a level: columns name, kind, role, lo, hi, principal."""
    over = (F.col("c_lo") <= F.col("r_hi")) & (F.col("r_lo") <= F.col("c_hi"))
    stem = lambda p: parse_name(F.col(p + "name"))["stem"]
    polarity = lambda p: parse_name(F.col(p + "name"))["polarity"]
    steps = {"span": over}
    steps["stem"] = over & (stem("c_") == stem("r_"))
    steps["deontic"] = steps["stem"] & polarity("c_").eqNullSafe(polarity("r_"))
    steps["principal"] = steps["deontic"] & F.col("c_principal").eqNullSafe(F.col("r_principal"))
    steps["role"] = steps["principal"] & F.col("c_role").eqNullSafe(F.col("r_role"))
    steps["name"] = over & (F.col("c_name") == F.col("r_name"))
    steps["exact"] = steps["name"] & (F.col("c_kind") == F.col("r_kind")) & (F.col("c_lo") == F.col("r_lo")) & (F.col("c_hi") == F.col("r_hi"))
    return steps[level]


def authority(sections: DataFrame, pattern: str = r"\{authority=([a-z-]+)\}") -> DataFrame:
    """sections with authority: a heading's own attribute, else the nearest one above it on its path. sections (id, section, level, title)."""
    own = F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), pattern, 1), F.lit(""))
    out, w = sections.withColumn("_own", own), Window.partitionBy("id").orderBy("section")
    for k in range(1, 7):
        out = out.withColumn(f"_a{k}", F.last(F.when(F.coalesce("level", F.lit(0)) <= k, F.struct(F.coalesce("level", F.lit(0)).alias("l"), F.col("_own").alias("o"))), True).over(w))
    inherited = F.coalesce(*(F.when((F.lit(k) <= F.col("level")) & (F.col(f"_a{k}.l") == k), F.col(f"_a{k}.o")) for k in range(6, 0, -1)))
    return out.withColumn("authority", inherited).drop("_own", *(f"_a{k}" for k in range(1, 7)))


def deduped_nodes(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """(id, keeps): nodes that repeat an earlier one in every column but id and order, with the id that stays; the others keep themselves.

    Equal means equal in full: columns are compared as canonical JSON by their SHA-256, so a hot group is one small aggregate.
    """
    body = sorted(c for c in nodes.columns if c not in ("id", order))
    marked = nodes.select("id", order, F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}), 256).alias("_h"))
    first = marked.groupBy("_h").agg(F.min(F.struct(order, "id"))["id"].alias("keeps"))
    return marked.join(first, "_h").select("id", "keeps")


def merged_concepts(concepts: DataFrame, chosen: DataFrame) -> DataFrame:
    """concepts (run, node, ...) of the chosen (node, run) only: each node's rows come from the run its module was taken from."""
    return concepts.join(chosen.select("node", "run").distinct(), ["node", "run"], "left_semi")


#: Slots of a node's feature vector and the declarations of a behaviour that read them; a slot that none reads is dead.
SLOT_READERS = {
    "contexts": ("governs_conditional",), "gc_pairs": ("governs_conditional",), "refinements": (), "protects": ("protects_concern",), "purposes": ("purpose_concern",),
    "arbitration": ("arbitrates_wall", "arbitrates_channel"), "machinery": ("machinery_concern",), "party": ("party_concern",),
}


def dead_slots(declared: set[str]) -> list[str]:
    """Slots that a behaviour with these declarations never reads, in the order of SLOT_READERS."""
    return [s for s, readers in SLOT_READERS.items() if not declared.intersection(readers)]


def masked_census(vectors: DataFrame, declared: set[str]) -> DataFrame:
    """satisfiability_census() over the slots that a behaviour reads: nodes that differ in dead slots only can't be told apart by it."""
    return satisfiability_census(vectors.drop(*dead_slots(declared)))


def extension_characters(spans: DataFrame) -> DataFrame:
    """(name, n): distinct characters that a name's spans (name, section, lo, hi half-open) cover, from merged intervals, so no character becomes a row."""
    return merged_spans(spans).groupBy("name").agg(F.sum(F.col("hi") - F.col("lo")).alias("n"))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(name, section, lo, hi): overlapping or touching spans of a name and section as one. Empty spans are dropped."""
    w = Window.partitionBy("name", "section").orderBy("lo", "hi")
    s = spans.where("lo < hi").select("name", "section", "lo", "hi").distinct()
    s = s.withColumn("_top", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_g", F.sum(F.coalesce((F.col("lo") > F.col("_top")).cast("int"), F.lit(1))).over(w))
    return s.groupBy("name", "section", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_g")


def extension_similarity(spans: DataFrame, width: int = 200) -> DataFrame:
    """(a, b, jaccard) of names whose extensions share characters: shared over covered. Spans of a section meet in blocks of ``width``."""
    m = merged_spans(spans)
    cells = m.select("name", "section", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    cells = cells.select("name", "section", "cell", F.greatest("lo", F.col("cell") * width).alias("lo"), F.least("hi", (F.col("cell") + 1) * width).alias("hi"))
    l, r = (cells.select("section", "cell", F.col("name").alias(x), F.col("lo").alias("l" + x), F.col("hi").alias("h" + x)) for x in "ab")
    both = l.join(r, ["section", "cell"]).where("a < b and la < hb and lb < ha").groupBy("a", "b").agg(F.sum(F.least("ha", "hb") - F.greatest("la", "lb")).alias("k"))
    n = extension_characters(spans)
    j = both.join(n.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("jaccard"))


def extension_clusters(spans: DataFrame, bar: float) -> DataFrame:
    """(name, root): names linked by extensions at least this similar, under the smallest name of each group."""
    links = extension_similarity(spans).where(F.col("jaccard") >= bar).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return clusters(spans.select("name").distinct(), links, "name")
