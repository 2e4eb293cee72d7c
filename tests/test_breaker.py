"""The early stop on a stream, against the batch rule."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import report
from foliant.streaming import breaker

SCHEMA = "run string, idx long, st string"


def attempts(spark, sf_dir):
    """The events of some users as attempts."""
    st = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "cache").when(F.col("event_type") == "signup", "blocked").otherwise("ok")
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 7 = 1").select(F.col("user_id").cast("string").alias("run"), idx.cast("long").alias("idx"), st.alias("st"))
    return [tuple(r) for r in rows.collect()]


def machine_alone(rows, most, refresh):
    out = set()
    for run in {r[0] for r in rows}:
        m = breaker.Machine(1, 0, False, most, refresh)
        out |= {(run, i) for _, i, st in sorted(r for r in rows if r[0] == run) if m.take(st)}
    return out


def test_the_machine_equals_the_batch_rule(spark):
    rng = random.Random(1)
    rows = [(str(r), i, rng.choice(["ok", "error", "error", "cache", "blocked" if rng.random() < 0.1 else "error"])) for r in range(40) for i in range(1, rng.randrange(2, 30))]
    frame = spark.createDataFrame(rows, SCHEMA)
    for most, refresh in ((1, False), (3, False), (3, True)):
        assert machine_alone(rows, most, refresh) == {tuple(r) for r in report.breaker(frame, ["run"], most, refresh).collect()}


def replay(spark, tmp_path, batches, **more):
    for i, rows in enumerate(batches):
        if rows is not None:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = breaker.failed_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), **more)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(once=True).start()
        assert q.awaitTermination(100)
        assert q.exception() is None
    return sorted(tuple(r) for r in spark.read.schema("run string, idx long").parquet(str(tmp_path / "out")).collect())


def test_events_replayed_out_of_order(spark, sf_dir, tmp_path):
    rows = attempts(spark, sf_dir)
    rng = random.Random(2)
    mixed = rng.sample(rows, len(rows))
    third = len(mixed) // 3
    batches = [mixed[:third], mixed[third : 2 * third] + mixed[:20], mixed[2 * third :]]  # some come twice
    want = sorted(tuple(r) for r in report.breaker(spark.createDataFrame(rows, SCHEMA), ["run"], 3).collect())
    assert want and replay(spark, tmp_path, batches, most=3) == want


def test_an_attempt_that_never_comes_is_given_up(spark, tmp_path):
    batches = [[("a", 1, "error"), ("a", 3, "error"), ("a", 4, "ok")], [("b", 1, "ok")], [("b", 2, "error"), ("a", 2, "error")]]
    assert replay(spark, tmp_path, batches, most=2, patience_ms=1) == [("a", 1), ("a", 3), ("a", 4), ("b", 2)]
