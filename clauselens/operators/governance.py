"""Governance facts as tables: queries over them, and the contradictions that they hold.

Facts are DataFrames by name. A name that is missing counts as empty, so partial fact bases work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The facts that contradictions() reads, with their columns.
FACTS = {
    "claim_retracted": "claim string, file string", "claim_asserted": "claim string, file string",
    "verdict": "id string, side string, cause string", "side_asserts_no_fault": "side string", "cause_kind": "cause string, kind string", "fault_asserting_kind": "kind string",
    "gate_reads_constant": "gate string, constant string", "provenance": "constant string, source string",
    "gate_blocks": "gate string, phase string", "phase_order": "shape string, phase string, place int", "overridable": "phase string",
    "escape_path": "gate string, how string", "escape_unverified": "gate string, what string",
    "seat": "seat string", "seat_tier": "seat string, tier string", "seat_validator": "seat string, validator string", "seat_validator_missing": "seat string",
}


def solve(spark: SparkSession, facts: dict[str, DataFrame], program: list[tuple[str, str]], show: str) -> DataFrame:
    """Rows of the relation ``show``. program: (name, SQL) pairs, each over the facts and the relations before it.

    Relations are views of their own names for the duration of the call only; the result is a plan, so nothing is computed here.
    """
    names = []
    try:
        for name, df in facts.items():
            df.createOrReplaceTempView(name)
            names.append(name)
        for name, sql in program:
            spark.sql(sql).createOrReplaceTempView(name)
            names.append(name)
        return spark.table(show)
    finally:
        for name in names:
            spark.catalog.dropTempView(name)


def contradictions(spark: SparkSession, facts: dict[str, DataFrame], low_tier: str) -> DataFrame:
    """(kind, subject, detail) of the six ways in which governance facts contradict each other. low_tier: the tier that doesn't go with any other on one seat."""
    f = {name: facts.get(name, spark.createDataFrame([], schema)) for name, schema in FACTS.items()}
    say = lambda df, kind, subject, detail: df.select(F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.col(detail).cast("string").alias("detail"))
    gone, live = f["claim_retracted"].select("claim", "file").distinct(), f["claim_asserted"].select("claim", "file").distinct()
    here = live.join(gone, ["claim", "file"], "left_semi")
    elsewhere = live.join(gone.select("claim").distinct(), "claim", "left_semi").join(gone, ["claim", "file"], "left_anti")
    no_fault = f["verdict"].join(f["side_asserts_no_fault"], "side", "left_semi").join(f["cause_kind"].join(f["fault_asserting_kind"], "kind", "left_semi"), "cause", "left_semi")
    chosen = f["gate_reads_constant"].join(f["provenance"].where("source = 'chosen'"), "constant", "left_semi")
    phases = f["phase_order"].select("phase").distinct().join(f["overridable"], "phase", "left_anti")
    hard = f["gate_blocks"].join(phases, "phase", "left_semi").select("gate").distinct()
    ways = f["escape_path"].select("gate").distinct()
    two = f["seat_tier"].where(F.col("tier") == low_tier).join(f["seat_tier"].where(F.col("tier") != low_tier).select("seat").distinct(), "seat", "left_semi")
    seats = f["seat"].select("seat").distinct()
    declared = seats.join(f["seat_validator_missing"], "seat", "left_semi").withColumn("why", F.lit("declared missing"))
    silent = seats.join(f["seat_validator_missing"], "seat", "left_anti").join(f["seat_validator"], "seat", "left_anti").withColumn("why", F.lit("neither given nor declared missing"))
    parts = [
        say(here, "retracted claim still asserted in the same file", "claim", "file"),
        say(elsewhere, "retracted claim asserted in another file", "claim", "file"),
        say(no_fault, "verdict without fault carries a fault's cause", "id", "cause"),
        say(chosen, "gate reads a chosen constant", "gate", "constant"),
        say(f["escape_path"].join(hard, "gate", "left_semi"), "gate that can't be overridden has an escape", "gate", "how"),
        say(f["escape_unverified"].join(ways, "gate", "left_semi"), "escape is unverified", "gate", "what"),
        say(two, "seat has conflicting tiers", "seat", "tier"),
        say(declared.union(silent), "seat without validator", "seat", "why"),
    ]
    return reduce(DataFrame.union, parts).distinct()
