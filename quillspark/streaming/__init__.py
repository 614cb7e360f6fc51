"""Folds of command streams; each works on a table at rest as well, with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def partial_responses(commands: DataFrame) -> DataFrame:
    """What a set of commands says of each (attempt, question): the last choice and mark with their times, sums and maxima."""
    at = F.col("ms") * 1000000 + F.col("event_id")
    kind = F.col("event_type")
    choice, mark = kind.isin("click", "error"), kind.isin("purchase", "signup")
    return commands.groupBy("attempt_id", "question_no").agg(
        F.min("user_id").alias("user_id"),
        F.max(F.when(choice, at)).alias("chosen_at"),
        F.max_by(F.when(kind == "click", F.col("chosen")).otherwise(""), F.when(choice, at)).alias("raw_chosen"),
        F.max(F.when(kind == "view", 1).otherwise(0)).alias("visited"),
        F.max(F.when(mark, at)).alias("marked_at"),
        F.max_by(F.when(kind == "purchase", 1).otherwise(0), F.when(mark, at)).alias("marked"),
        F.sum("time_ms").alias("time_ms"),
        F.max("ms").alias("last_ms"),
    )


def joined_responses(partial: DataFrame) -> DataFrame:
    """Partial states of several sets of commands as one; in any order and grouping."""
    return partial.groupBy("attempt_id", "question_no").agg(
        F.min("user_id").alias("user_id"),
        F.max("chosen_at").alias("chosen_at"),
        F.max_by("raw_chosen", "chosen_at").alias("raw_chosen"),
        F.max("visited").alias("visited"),
        F.max("marked_at").alias("marked_at"),
        F.max_by("marked", "marked_at").alias("marked"),
        F.sum("time_ms").alias("time_ms"),
        F.max("last_ms").alias("last_ms"),
    )


def merged_responses(partial: DataFrame) -> DataFrame:
    """State of each (attempt, question): the last explicit choice or clearing, the last mark, whether visited, time spent."""
    return joined_responses(partial).select("attempt_id", "question_no", "user_id", "raw_chosen", "visited", F.coalesce("marked", F.lit(0)).alias("marked"), "time_ms", "last_ms")


def fold_responses(commands: DataFrame) -> DataFrame:
    """The state of each (attempt, question) at rest; rows may come in any order."""
    return merged_responses(partial_responses(commands))


def open_stream(spark, path: str, schema) -> DataFrame:
    """Rows of a Parquet table, a file or a folder given by a pattern, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def batches(stream: DataFrame, tag: str, mode: str = "update", made=lambda batch: batch) -> DataFrame:
    """Run a stream over all that is there; of each batch, what ``made`` makes of it, with the column batch.

    Each batch is a table of its own under its number, so a batch that runs again replaces itself."""
    from quillspark.sources.folders import scratch

    spark = stream.sparkSession
    path = scratch(spark, tag)

    def write(batch: DataFrame, number: int) -> None:
        made(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", scratch(spark, f"{tag}-log")).trigger(availableNow=True).start().awaitTermination()
    shape = made(spark.createDataFrame([], stream.schema)).schema
    return spark.read.schema(StructType([*shape.fields, StructField("batch", IntegerType())])).parquet(path)


def settle(stream: DataFrame, keys: list[str], tag: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there and return the last row of each key."""
    rows = batches(stream, tag, mode)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")) if rest else rows.select(*keys).distinct()
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


class FoldedTable:
    """What a stream's batches add up to: a log of batches, and snapshots that each stand for all batches up to one.

    Every ``every`` batches the last snapshot and the log since are joined into the next snapshot; a mark, written after it,
    makes it count, and what it stands for is deleted once the one after it counts. So a reader meets one snapshot and less
    than twice ``every`` batches, however long the stream runs. A batch that runs again replaces itself in the log, or changes nothing
    if a snapshot stands for it. A snapshot that was not finished has no mark and is written anew."""

    def __init__(self, spark, path: str, made, joined, every: int = 8):
        self.spark, self.path, self.made, self.joined, self.every = spark, path, made, joined, every

    def _numbers(self, folder: str) -> list[int]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []

    def _delete(self, folder: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def _parts(self, upto: int | None = None) -> list[str]:
        """The last snapshot that counts and the batches after it."""
        marks = self._numbers("marks")
        last = marks[-1] if marks else -1
        return [f"snapshots/{last}"] * bool(marks) + [f"log/{n}" for n in self._numbers("log") if n > last and (upto is None or n <= upto)]

    def write(self, batch: DataFrame, number: int) -> None:
        marks = self._numbers("marks")
        last = marks[-1] if marks else -1
        if number <= last:
            return
        self.made(batch).write.mode("overwrite").parquet(f"{self.path}/log/{number}")
        if number - last < self.every:
            return
        whole = self.joined(self.spark.read.parquet(*[f"{self.path}/{p}" for p in self._parts(number)]))
        whole.write.mode("overwrite").parquet(f"{self.path}/snapshots/{number}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.path}/marks/{number}")
        # The snapshot before stays until the next one counts: a reader may be at it.
        for n in self._numbers("log"):
            if n <= last:
                self._delete(f"log/{n}")
        for n in marks[:-1]:
            self._delete(f"snapshots/{n}")
            self._delete(f"marks/{n}")

    def read(self, schema) -> DataFrame:
        """Partial states, at most a few for each key."""
        parts = self._parts()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)


def stream_responses(commands: DataFrame, every: int = 8) -> DataFrame:
    """The state of each (attempt, question) after a stream: batches are folded each by itself and joined into snapshots.

    No state is kept between batches, so none has to end, and commands of any lateness count."""
    from quillspark.sources.folders import scratch

    spark = commands.sparkSession
    table = FoldedTable(spark, scratch(spark, "responses"), partial_responses, joined_responses, every)
    commands.writeStream.foreachBatch(table.write).option("checkpointLocation", scratch(spark, "responses-log")).trigger(availableNow=True).start().awaitTermination()
    return merged_responses(table.read(partial_responses(spark.createDataFrame([], commands.schema)).schema))


OPENS, CLOSES, ENDS = ("view", "signup"), ("error",), ("submit",)
#: What a command does, in a stream's state.
STAY, OPEN, CLOSE, END = range(4)
#: An attempt without a command for so long has been left: the time is not active, and it is closed.
IDLE_MS = 30 * 86_400_000


def fold_time(commands: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Active time of each attempt, at rest: the time between commands while it is open.

    View and signup open it, error pauses it, submit ends it, and so does a gap of more than ``idle_ms``, which does not count."""
    from pyspark.sql import Window

    w = Window.partitionBy("attempt_id").orderBy("ms", "event_id")
    gap = F.col("ms") - F.lag("ms").over(w)
    kind = F.col("event_type")
    sign = F.when(kind.isin(*OPENS), 1).when(kind.isin(*CLOSES, *ENDS), 0)
    left = commands.select("attempt_id", "ms", "event_id", sign.alias("sign"), gap.alias("gap"))
    # After a gap the attempt is closed until something opens it.
    state = F.last(F.when(F.col("gap") > idle_ms, F.coalesce("sign", F.lit(0))).otherwise(F.col("sign")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when((state == 1) & (F.col("gap") <= idle_ms), F.col("gap")).otherwise(0)
    return left.select("attempt_id", step.alias("step"), "ms").groupBy("attempt_id").agg(F.sum("step").alias("active_ms"), F.max("ms").alias("last_ms"))


def stream_time(commands: DataFrame, delay: str = "1 hour", idle_ms: int = IDLE_MS) -> DataFrame:
    """Active time of a stream: attempt_id, spell, active_ms, last_ms, whatever order commands of the last ``delay`` come in.

    State of an attempt, one value that is read and written once a batch: what is folded, up to the watermark, and its commands since,
    which are folded anew for each row given out. Commands older than what is folded come too late and are left out. A timer ends
    an attempt, and its state goes, once the watermark is ``idle_ms`` past its last command, or past the command that
    submitted it; what comes later is another spell (named by a time of its first batch), which counts by itself."""
    from pyspark.sql import Row
    from pyspark.sql.streaming import StatefulProcessor

    class TimeFold(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            # last_ms is null until a command is folded; the lists are of commands that wait, in order.
            self.state = handle.getValueState("attempt", "spell long, ends long, active_ms long, last_ms long, is_open boolean, is_over boolean, ms array<long>, event_id array<long>, sign array<long>")

        def handleInputRows(self, key, rows, timer):
            mark = timer.getCurrentWatermarkInMs()
            spell, ends, *folded, ms, event, sign = self.state.get() or (None, None, 0, None, False, False, [], [], [])
            held = list(zip(ms, event, sign, strict=True))
            held += [(r.ms, r.event_id, r.sign) for r in rows if folded[1] is None or r.ms > folded[1]]
            if not held and folded[1] is None:
                return
            held.sort()
            if spell is None:
                spell = held[0][0]
            now, left = tuple(folded), len(held)
            for i, (ms, _, sign) in enumerate(held):
                spent, last, is_open, _ = now
                is_open = is_open and ms - last <= idle_ms
                now = (spent + (ms - last if is_open else 0), ms, sign == OPEN or (is_open and sign == STAY), sign == END)
                if ms < mark:
                    folded = now
                else:
                    left = min(left, i)
            due = max(now[1] + (1 if now[3] else idle_ms + 1), mark + 1)
            if due != ends:
                if ends is not None:
                    self.handle.deleteTimer(ends)
                self.handle.registerTimer(due)
            self.state.update((spell, due, *folded, *([x[c] for x in held[left:]] for c in range(3))))
            yield Row(attempt_id=key[0], spell=spell, active_ms=now[0], last_ms=now[1])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.state.clear()
            return iter(())

        def close(self):
            pass

    kind = F.col("event_type")
    sign = F.when(kind.isin(*OPENS), OPEN).when(kind.isin(*CLOSES), CLOSE).when(kind.isin(*ENDS), END).otherwise(STAY)
    # Only what a fold needs goes to Python.
    at = commands.select("attempt_id", "ms", "event_id", sign.cast("long").alias("sign"), F.timestamp_millis("ms").alias("at")).withWatermark("at", delay)
    return at.groupBy("attempt_id").transformWithState(statefulProcessor=TimeFold(), outputStructType="attempt_id string, spell long, active_ms long, last_ms long", outputMode="Update", timeMode="EventTime")


def times(spells: DataFrame) -> DataFrame:
    """Active time of each attempt from the last rows of its spells."""
    return spells.groupBy("attempt_id").agg(F.sum("active_ms").alias("active_ms"), F.max("last_ms").alias("last_ms"))


def mistake_sink(commands: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mistakes with deterministic ids, each once however often the stream is replayed within the delay."""
    made = commands.filter(F.col("event_type").isin("error", "purchase")).withColumn("mistake_id", F.substring(F.sha1(F.concat_ws("|", "attempt_id", F.col("question_no").cast("string"), F.col("ms").cast("string"))), 1, 12))
    at = made.withColumn("at", F.timestamp_millis("ms"))
    return (at.withWatermark("at", delay).dropDuplicatesWithinWatermark(["mistake_id"]) if commands.isStreaming else at.dropDuplicates(["mistake_id"])).select("mistake_id", "attempt_id", "user_id", "question_no", "ms")


def weakness_counts(mistakes: DataFrame, delay: str = "30 days") -> DataFrame:
    """Running count of mistakes of each user by subject and day, the day bounded by the watermark."""
    at = mistakes.withColumn("at", F.timestamp_millis("ms"))
    at = at.withWatermark("at", delay) if mistakes.isStreaming else at
    return at.groupBy("user_id", "subject", F.window("at", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "subject", F.unix_millis("w.start").alias("day_ms"), "n")
