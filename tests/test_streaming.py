"""Streaming variants, each driven to completion over files."""

import datetime

from pyspark.sql import functions as F

from clauselens.streaming import logs


def test_streams(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [("p", "a", 2, at, i) for i in range(3)] + [("p", "b", 2, at + datetime.timedelta(minutes=5), 9), ("q", "c", 2, at, 1)]
    src = str(tmp_path / "src")
    schema = "parent string, child string, children int, at timestamp, n int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)

    def done(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    assert len(done(logs.exactly_once(read(), ["parent", "child"], "at"), "append", "once")) == 3
    assert [(r.parent, r.children) for r in done(logs.ready_parents(read()), "append", "ready")] == [("p", 2)]
    counts = done(logs.windowed_counts(read(), "at", "parent"), "complete", "windows")
    assert {r.parent: r.n for r in counts} == {"p": 4, "q": 1}
    replies = read().select(F.col("parent").alias("id"), F.lit(False).alias("valid"), (F.col("child") == "c").alias("fixable"))
    assert {r.id: (r.state, r.rounds) for r in done(logs.dispatch_states(replies), "update", "states")} == {"p": ("failed", 3), "q": ("repaired", 0)}
    logs.append_batches(read(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
