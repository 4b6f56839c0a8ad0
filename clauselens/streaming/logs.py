"""Structured Streaming variants: exactly-once log rows, ready parents, windows, dispatch states."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def exactly_once(log: DataFrame, keys: list[str], at: str, delay: str = "1 hour") -> DataFrame:
    """A stream of log rows with each key once; state is dropped after the watermark."""
    return log.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by window and kind; late rows within the delay are counted."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, delay).groupBy(w, kind).agg(F.count(F.lit(1)).alias("n"))


def _resumable(kind: str) -> tuple[str, str]:
    return {"ready": ("parent string, children long", "done array<string>"), "dispatch": ("id string, state string, rounds int", "state string, rounds int")}[kind]


def ready_parents(done: DataFrame) -> DataFrame:
    """Each parent once, when all its children are done. done (parent, child, children): rows of a stream, repeats allowed."""
    out, state = _resumable("ready")

    def feed(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        seen, n = set(held.get[0]) if held.exists else set(), 0
        told = "" in seen
        for pdf in frames:
            seen |= set(pdf.child)
            n = int(pdf.children.max())
        if n and len(seen - {""}) >= n and not told:
            seen.add("")
            yield pd.DataFrame({"parent": [key[0]], "children": [n]})
        held.update((sorted(seen),))

    return done.groupBy("parent").applyInPandasWithState(feed, out, state, "append", GroupStateTimeout.NoTimeout)


def dispatch_states(replies: DataFrame, rounds: int = 2) -> DataFrame:
    """(id, state, rounds) after each reply of a stream (id, valid, fixable): done, repaired, repair (a further round) or failed.

    A valid reply is done; a fixable one is repaired at once; others ask for a further round until none is left.
    """
    out, state = _resumable("dispatch")

    def feed(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, used = held.get if held.exists else ("open", 0)
        for pdf in frames:
            for valid, fixable in zip(pdf.valid, pdf.fixable, strict=True):
                if now in ("done", "repaired", "failed"):
                    break
                if valid or fixable:
                    now = "done" if valid else "repaired"
                else:
                    used += 1
                    now = "failed" if used > rounds else "repair"
        held.update((now, used))
        yield pd.DataFrame({"id": [key[0]], "state": [now], "rounds": [used]})

    return replies.groupBy("id").applyInPandasWithState(feed, out, state, "update", GroupStateTimeout.NoTimeout)


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends each micro-batch once: a batch's folder carries its number and is replaced if it runs again."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


class InFlight:
    """Records of work that is under way, one folder of JSON a job, in a folder that all machines see.

    A record stands from the moment work is given out until its results are written. A killed process
    leaves it behind; sweep() shows such orphans and never removes one, so they are settled before clear().
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def record(self, name: str, entry: dict) -> None:
        """Write or replace a job's record; it appears whole or not at all."""
        body = self.spark.createDataFrame([(name, json.dumps(entry, sort_keys=True))], "name string, entry string")
        new = f"{self.path}/.new-{uuid.uuid4().hex}"
        body.coalesce(1).write.json(new)
        fs, to = self._fs(f"{self.path}/{name}")
        fs.delete(to, True)
        fs.rename(self._fs(new)[1], to)

    def sweep(self) -> DataFrame:
        """(name, entry) of all records, entry as JSON."""
        fs, at = self._fs(self.path)
        schema = "name string, entry string"
        names = sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []
        found = [f"{self.path}/{n}" for n in names if not n.startswith(".")]
        return self.spark.read.schema(schema).json(found) if found else self.spark.createDataFrame([], schema)

    def clear(self, name: str) -> None:
        """Remove a job's record; one that isn't there is no error."""
        fs, at = self._fs(f"{self.path}/{name}")
        fs.delete(at, True)
