"""Streams that come in several batches, out of order, end as the tables at rest do."""

import random

import pytest

from quillspark import streaming

COMMANDS = "event_id long, attempt_id string, user_id long, ms long, question_no long, event_type string, chosen string, time_ms long"


@pytest.fixture(scope="module")
def commands(spark, tmp_path_factory):
    """Commands of an hour in two files, every second one in the later file."""
    rng = random.Random(3)
    rows = [(i, f"a{i % 5}", i % 5, 1_000_000_000 + i * 7_000, i % 3, rng.choice(["view", "click", "error", "purchase", "signup"]), rng.choice("ABCD"), i) for i in range(400)]
    folder = str(tmp_path_factory.mktemp("commands"))
    for k in (0, 1):
        spark.createDataFrame(rows[k::2], COMMANDS).coalesce(1).write.mode("append").parquet(folder)
    return spark.createDataFrame(rows, COMMANDS), spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(folder)


def as_set(df):
    return {tuple(r[c] for c in sorted(df.columns)) for r in df.collect()}


def test_responses(commands):
    rest, stream = commands
    assert as_set(streaming.stream_responses(stream)) == as_set(streaming.fold_responses(rest))


def test_time(spark, commands):
    rest, stream = commands
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = streaming.times(streaming.settle(streaming.stream_time(stream), ["attempt_id", "spell"], "time"))
    finally:
        spark.conf.unset(name)
    assert as_set(got) == as_set(streaming.fold_time(rest)) and len(got.collect()) == 5


HOUR = 3_600_000


def stream_of(spark, folder, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, COMMANDS).coalesce(1).write.mode("append").parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


def test_state_of_ended_attempts_goes(spark, tmp_path):
    """Submitted and left attempts lose their state; a left one that comes back is another spell."""
    rows, n = [], 0
    for hour in range(40):
        batch = []
        if hour < 3:
            for a in range(20):
                for kind in ("view", "click") + (("submit",) if hour == 2 and a % 2 else ()):
                    batch.append((n, f"a{a}", a, (hour + 1) * HOUR + a * 1000 + n % 7, 1, kind, "A", 1))
                    n += 1
        batch.append((n, "clock", 0, (hour + 1) * HOUR + 30_000, 1, "view", None, 1))
        n += 1
        rows.append(batch)
    rows[-1] += [(n, "a4", 4, 40 * HOUR, 1, "view", None, 1), (n + 1, "a4", 4, 40 * HOUR + 500, 1, "click", None, 1)]
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out, log = str(tmp_path / "out"), str(tmp_path / "log")
        made = streaming.stream_time(stream_of(spark, str(tmp_path / "in"), rows), "1 minute", 5 * HOUR)
        run = made.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/batch={k}")).outputMode("update").option("checkpointLocation", log).trigger(availableNow=True).start()
        run.awaitTermination()
        held = [p.stateOperators[0].numRowsTotal for p in run.recentProgress if p.stateOperators]
    finally:
        spark.conf.unset(name)
    assert max(held[:4]) > 20 and held[-2] <= 5 and len(held) >= 40
    from pyspark.sql import functions as F

    last = spark.read.parquet(out).groupBy("attempt_id", "spell").agg(F.max_by(F.struct("active_ms", "last_ms"), "batch").alias("x")).select("attempt_id", "spell", "x.*")
    want = streaming.fold_time(spark.createDataFrame([r for b in rows for r in b], COMMANDS), 5 * HOUR)
    assert as_set(streaming.times(last)) == as_set(want)
    assert last.filter("attempt_id = 'a4'").count() == 2


def test_snapshots_bound_what_is_read(spark, tmp_path):
    """Fifty batches end as one snapshot and a short log; batches that run again change nothing."""
    rng = random.Random(9)
    rows = [(i, f"a{i % 6}", i % 6, 1_000_000 + rng.randrange(10**6), i % 4, rng.choice(["view", "click", "error", "purchase", "signup"]), rng.choice("ABCD"), i) for i in range(1000)]
    table = streaming.FoldedTable(spark, str(tmp_path / "table"), streaming.partial_responses, streaming.joined_responses, 8)
    want = as_set(streaming.fold_responses(spark.createDataFrame(rows, COMMANDS)))
    parts = [spark.createDataFrame(rows[k * 20 : k * 20 + 20], COMMANDS).coalesce(1) for k in range(50)]
    schema = streaming.partial_responses(parts[0]).schema
    for k, part in enumerate(parts):
        table.write(part, k)
    assert as_set(streaming.merged_responses(table.read(schema))) == want
    assert len(table._parts()) <= 8 and len(table._numbers("log")) <= 16 and len(table._numbers("snapshots")) <= 2
    for k in (49, 48, 3, 0):
        table.write(parts[k], k)
    assert as_set(streaming.merged_responses(table.read(schema))) == want
    # A snapshot without a mark does not count.
    parts[0].sparkSession.createDataFrame([], schema).write.parquet(str(tmp_path / "table/snapshots/50"))
    assert as_set(streaming.merged_responses(table.read(schema))) == want


def test_an_attempt_is_one_value_of_state(spark, commands, tmp_path):
    """A batch reads and writes one value for each attempt, and sends Python only what a fold needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        run = streaming.stream_time(commands[1]).writeStream.foreachBatch(lambda b, k: b.count()).outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        run.awaitTermination()
        (held,) = run.recentProgress[0].stateOperators
    finally:
        spark.conf.unset(name)
    # Each task counts its own.
    assert (held.customMetrics["numValueStateVars"], held.customMetrics["numListStateVars"]) == (held.numShufflePartitions, 0)
