"""Loaders: clause, annotation, query and panel files of several shapes into long tables; sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def first_existing(spark: SparkSession, paths: list[str], format: str = "json", **options) -> DataFrame:
    """The rows of the first path that can be read, with its label as ``source``; raises if none can."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.format(format).options(**options).load(path).withColumn("source", F.lit(path))
        except AnalysisException as e:
            last = e
    raise last


def clause_rows(raw: DataFrame) -> DataFrame:
    """Clause records from a list or from {clauses | rows | atoms | items: [...]}; unknown columns stay. Rows need id and text (or quote)."""
    for name in ("clauses", "rows", "atoms", "items"):
        if name in raw.columns:
            raw = raw.select(F.explode(name).alias("_r")).select("_r.*")
            break
    text = F.coalesce(*(F.col(c) for c in ("quote", "text") if c in raw.columns))
    return raw.withColumn("quote", text).where(F.col("id").isNotNull() & text.isNotNull())


ATOM = "array<struct<name:string,kind:string,gloss:string,clause_id:string>>"


def annotations(raw: DataFrame) -> DataFrame:
    """(id, name, kind) from a column json in any of three shapes.

    Clause-major {clauses: [{clause_id, atoms}]}, atom-major {atoms: [{name, kind, quote_spans:
    [{clause_id}]}]}, or a flat list of atoms with clause_id. Records without name or id are skipped.
    """
    j = F.col("json")
    one = raw.select(F.explode(F.from_json(F.get_json_object(j, "$.clauses"), f"array<struct<clause_id:string,atoms:{ATOM}>>")).alias("c")).select(F.col("c.clause_id").alias("id"), F.explode("c.atoms").alias("a")).select("id", "a.name", "a.kind")
    span = "array<struct<name:string,kind:string,quote_spans:array<struct<clause_id:string>>>>"
    two = raw.select(F.explode(F.from_json(F.get_json_object(j, "$.atoms"), span)).alias("a")).select(F.explode("a.quote_spans.clause_id").alias("id"), "a.name", "a.kind")
    three = raw.where(F.ltrim(j).startswith("[")).select(F.explode(F.from_json(j, ATOM)).alias("a")).select(F.col("a.clause_id").alias("id"), "a.name", "a.kind")
    return one.union(two).union(three).where("name is not null and id is not null").distinct()


def query_atoms(raw: DataFrame) -> DataFrame:
    """(q, name, kind, weight) from a column json {slug: [atom]}; slugs that begin with _ are skipped, weight is 2 where absent."""
    atom = "array<struct<name:string,kind:string,weight:int>>"
    m = raw.select(F.explode(F.from_json("json", f"map<string,{atom}>")).alias("q", "atoms")).where(~F.col("q").startswith("_"))
    return m.select("q", F.explode("atoms").alias("a")).select("q", "a.name", "a.kind", F.coalesce("a.weight", F.lit(2)).alias("weight")).where("name is not null")


def verdict_map(text: Column) -> Column:
    """map of judge to 0, 1 or 2 from JSON or a quoted-dict rendering of it; other values go, malformed text is null. Never evaluated as code."""
    parsed = F.from_json(F.translate(text, "'", '"'), "map<string,int>")
    return F.map_filter(parsed, lambda _, v: v.isin(0, 1, 2))


def votes(panel: DataFrame) -> DataFrame:
    """(id, judge, verdict) from a panel with a verdicts text."""
    return panel.select("id", F.explode(verdict_map(F.col("verdicts"))).alias("judge", "verdict"))


PASSAGE = "struct<id:string,locator:string,quote:string,exampleBlock:boolean,verdicts:map<string,int>,score:int>"


def panel_rows(raw: DataFrame) -> DataFrame:
    """(behaviour, spec, id, locator, quote, example, score, verdicts) from a column json {behaviours: [{slug, coverage: {spec: {passages}}}]}.

    A missing example flag is false, a missing score 0; verdicts outside 0, 1, 2 go.
    """
    schema = f"struct<behaviours:array<struct<slug:string,coverage:map<string,struct<passages:array<{PASSAGE}>>>>>>"
    b = raw.select(F.explode(F.from_json("json", schema)["behaviours"]).alias("b")).select(F.col("b.slug").alias("behaviour"), F.explode("b.coverage").alias("spec", "c"))
    p = b.select("behaviour", "spec", F.explode("c.passages").alias("p"))
    return p.select("behaviour", "spec", "p.id", "p.locator", "p.quote", F.coalesce("p.exampleBlock", F.lit(False)).alias("example"), F.coalesce("p.score", F.lit(0)).alias("score"), F.map_filter("p.verdicts", lambda _, v: v.isin(0, 1, 2)).alias("verdicts"))


EXTRACTION = (
    "struct<rules:array<struct<id:string,modality:string,act:string,tier:int,locator:string,conditions:array<string>,defeaters:array<struct<conditions:array<string>,source:string>>>>,"
    "exclusions:array<struct<kind:string,atoms:array<string>>>,incompat:array<struct<acts:array<string>>>>"
)


def extraction_tables(raw: DataFrame) -> dict[str, DataFrame]:
    """The tables that operators/rules.py works on, from rule extractions in a column json; a norm is section:id.

    norm (norm, act, modality, tier, locator), norm_condition (norm, atom), defeater_condition (norm, defeater, atom), exclusion (a, b; every pair
    of an exclusion's atoms, the smaller first), incompat (a, b). A rule without id is skipped, a missing tier is 0. raw (section, json).
    """
    x = raw.select("section", F.from_json("json", EXTRACTION).alias("x"))
    r = x.select("section", F.explode("x.rules").alias("r")).where("r.id is not null").select(F.concat_ws(":", "section", "r.id").alias("norm"), "r.*")
    pairs = lambda c: F.explode(F.flatten(F.transform(c, lambda a: F.transform(F.filter(c, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return {
        "norm": r.select("norm", "act", "modality", F.coalesce("tier", F.lit(0)).alias("tier"), "locator"),
        "norm_condition": r.select("norm", F.explode("conditions").alias("atom")).distinct(),
        "defeater_condition": r.select("norm", F.posexplode("defeaters").alias("i", "d")).select("norm", F.concat(F.lit("d"), F.col("i").cast("string")).alias("defeater"), F.explode("d.conditions").alias("atom")).distinct(),
        "exclusion": x.select(F.explode("x.exclusions").alias("e")).select(pairs(F.col("e.atoms")).alias("p")).select("p.*").distinct(),
        "incompat": x.select(F.explode("x.incompat").alias("e")).select(pairs(F.col("e.acts")).alias("p")).select("p.*").distinct(),
    }


def html_blocks(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, pos, tag, text): headings, paragraphs and list items of HTML, scripts, styles and comments taken out, entities read."""
    clean = F.col(html)
    for pattern in (r"(?is)<!--.*?-->", r"(?is)<(script|style)\b.*?</\1>"):
        clean = F.regexp_replace(clean, pattern, "")
    parts = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:h[1-6]|p|li|title)\b[^>]*>(?:(?!<(?:h[1-6]|p|li|title|/p|/li|/h[1-6]|/title|/article|/div|/body)\b).)*"), F.lit(0))
    rows = pages.select(F.col(id).alias("id"), F.posexplode(parts).alias("pos", "part"))
    text = F.regexp_replace("part", r"(?s)<[^>]*>", " ")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(by))
    return rows.select("id", "pos", F.lower(F.regexp_extract("part", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))


_TERM = re.compile(r"""<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^[^\s;,\]]+)?|([^\s;,\[\]]+?)(?=[\s;,\[\]]|\.(?:\s|$)|$)""")
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a Turtle text: prefixes, a, ; and , lists, literals, and blank nodes in brackets, which are named _:1, _:2 and on."""
    prefixes: dict[str, str] = {}
    body = re.sub(r"(?m)(?:^|\s)#[^\n]*", " ", text or "")
    for m in re.finditer(r"@?prefix\s+(\S*?):\s*<([^>]*)>\s*\.?", body, re.IGNORECASE):
        prefixes[m[1]] = m[2]
    body = re.sub(r"@?prefix\s+\S*?:\s*<[^>]*>\s*\.?", " ", body, flags=re.IGNORECASE)

    def name(t: str) -> str:
        head, colon, tail = t.partition(":")
        return TYPE if t == "a" else prefixes[head] + tail if colon and head in prefixes else t

    i, blanks, open_ = 0, 0, [[]]  # for each open bracket its subject, predicate and object so far
    while i < len(body):
        c = body[i]
        if c.isspace():
            i += 1
            continue
        now = open_[-1]
        if c in ";,.[]":
            i += 1
            if c == "[":
                blanks += 1
                open_.append([f"_:{blanks}"])
                continue
            if len(now) == 3:
                yield tuple(now)
            if c == "]" and len(open_) > 1:
                open_.pop()
                open_[-1].append(now[0])
            elif c == ",":
                del now[2:]
            elif c == ";":
                del now[1:]
            elif c == ".":
                open_ = [[]]
            continue
        m = _TERM.match(body, i)
        if not m or m.end() == i:
            i += 1
            continue
        now.append(m[1] if m[1] is not None else m[2] if m[2] is not None else name(m[3]))
        i = m.end()


def turtle_triples(files: DataFrame) -> DataFrame:
    """(path, s, p, o) of Turtle text (path, text), file by file; see _triples()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(path, *t) for path, text in zip(pdf.path, pdf.text, strict=True) for t in _triples(text)], columns=["path", "s", "p", "o"])

    return files.select("path", "text").mapInPandas(run, "path string, s string, p string, o string")


def xml_classes(spark: SparkSession, path: str) -> DataFrame:
    """(s, parent, label) of classes in RDF/XML, by the built-in XML reader."""
    schema = "`_rdf:about` string, `rdfs:label` string, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>"
    x = spark.read.format("xml").option("rowTag", "owl:Class").option("ignoreNamespace", "false").schema(schema).load(path)
    return x.select(F.col("`_rdf:about`").alias("s"), F.explode_outer("`rdfs:subClassOf`").alias("p"), F.col("`rdfs:label`").alias("label")).select("s", F.col("p.`_rdf:resource`").alias("parent"), "label")


def ontology(triples: DataFrame) -> DataFrame:
    """(s, parents, gloss) of the classes that triples declare."""
    end = lambda c, x: F.col(c).endswith(x)
    g = triples.groupBy("s").agg(F.bool_or(end("p", "type") & end("o", "Class")).alias("k"), F.array_sort(F.collect_set(F.when(end("p", "subClassOf"), F.col("o")))).alias("parents"), F.min(F.when(end("p", "comment"), F.col("o"))).alias("gloss"))
    return g.where("k").drop("k")


def append_json(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON log; the job's committer makes each append whole."""
    rows.write.mode("append").json(path)


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON log; malformed lines are skipped."""
    row = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).select(row.alias("r")).where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def write_once(rows: DataFrame, path: str, force: bool = False) -> None:
    """Write a snapshot; an existing one is replaced only by force."""
    rows.write.mode("overwrite" if force else "errorifexists").parquet(path)
