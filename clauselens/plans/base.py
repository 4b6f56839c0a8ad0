"""What query modules share: tables, the query register, and SQL pieces for the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import STEM_ROUNDS, STOPWORDS, SUFFIXES
from ..operators.resample import POISSON
from ..workers import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(rows) if name == "documents" else rows


def query(sql: str | None = None):
    """Register a function of Tables under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def tokens_sql(table: str, id: str, text: str = "text", p: str = "") -> str:
    """Common table expressions that end in {p}tok (id, term), one row per stemmed token."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
    out = [
        f"{p}w AS (SELECT {id} AS id, unnest(regexp_extract_all(replace(lower(coalesce({text}, '')), '_', ' '), '[a-z][a-z'']+')) AS t FROM {table})",
        f"{p}s0 AS (SELECT id, regexp_replace(t, '''+$', '') AS t FROM {p}w WHERE t NOT IN ({stop}))",
    ]
    for k in range(1, STEM_ROUNDS + 1):
        out.append(
            f"{p}s{k} AS (SELECT id, CASE WHEN c <> t AND c LIKE '%i' AND length(c) > 4 THEN left(c, length(c) - 1) || 'y' ELSE c END AS t "
            f"FROM (SELECT id, t, regexp_replace(t, '^(.{{4,}}?)(?:{'|'.join(SUFFIXES)})$', '\\1') AS c FROM {p}s{k - 1}))"
        )
    out.append(f"{p}tok AS (SELECT id, t AS term FROM {p}s{STEM_ROUNDS} WHERE t <> '')")
    return ",\n".join(out)


def uniform_sql(parts: str, seed: int = 17) -> str:
    """uniform() in SQL; parts: texts, comma-separated."""
    return f"(('0x' || left(md5(concat_ws(':', '{seed}', {parts})), 8))::BIGINT / 4294967296.0)"


def poisson_sql(parts: str, seed: int = 17) -> str:
    """poisson(uniform()) in SQL."""
    u = uniform_sql(parts, seed)
    return "list_sum([" + ", ".join(f"({u} >= {p})::INT" for p in POISSON) + "])::BIGINT"


DOC_TOK = tokens_sql("documents", "doc_id")
BENCH_TOK = tokens_sql("benchmark", "item_id", p="b")


def otsu_sql(scores: str, key: str = "key") -> str:
    """Common table expressions over {scores} (key, score) that end in otsu_cut (key, cut)."""
    return f"""
ext AS (SELECT {key}, min(score) FILTER (score > 0) AS lo, max(score) FILTER (score > 0) AS hi FROM {scores} GROUP BY {key}),
h AS (SELECT s.{key}, least(255, floor((s.score - lo) / ((hi - lo) / 256)))::INT AS bin, count(*) AS c, any_value(lo) AS lo, any_value((hi - lo) / 256) AS wd FROM {scores} s JOIN ext e ON s.{key} = e.{key} WHERE s.score > 0 AND hi > lo GROUP BY ALL),
h2 AS (SELECT {key}, bin, lo + wd * (bin + 1) AS edge, sum(c) OVER u AS w0, sum(c * (lo + wd * (bin + 0.5))) OVER u AS s0, sum(c) OVER (PARTITION BY {key}) AS n, sum(c * (lo + wd * (bin + 0.5))) OVER (PARTITION BY {key}) AS s FROM h WINDOW u AS (PARTITION BY {key} ORDER BY bin ROWS UNBOUNDED PRECEDING)),
h3 AS (SELECT {key}, edge, row_number() OVER (PARTITION BY {key} ORDER BY round((w0 / n) * ((n - w0) / n) * (s0 / w0 - (s - s0) / (n - w0)) * (s0 / w0 - (s - s0) / (n - w0)), 9) DESC, bin) AS rn FROM h2 WHERE w0 < n),
otsu_cut AS (SELECT e.{key}, CASE WHEN lo IS NULL OR lo = hi THEN 2.0 ELSE edge END AS cut FROM ext e LEFT JOIN h3 ON e.{key} = h3.{key} AND rn = 1)"""
