"""The canonical tables, built from the given ones; the only place that knows their names. PRELUDE is the same in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import KEY_LEGEND, accepted

PRELUDE = """
WITH papers AS (
  SELECT o_orderkey AS paper_id, c_mktsegment AS exam_code, o_orderpriority AS paper_type, CAST(o_orderdate AS DATE) AS held_on,
    CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS review_status,
    o_totalprice AS price, o_custkey AS user_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS pos FROM lineitem),
questions AS (
  SELECT l_orderkey AS paper_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(pos AS VARCHAR) AS question_id, pos, CAST(l_linenumber AS BIGINT) AS number,
    CASE l_linestatus WHEN 'O' THEN 'I' ELSE 'II' END AS part,
    CASE WHEN l_partkey % 17 <> 0 THEN p_type END AS subject,
    CASE WHEN l_partkey % 5 <> 0 THEN p_brand END AS topic_id,
    CASE WHEN l_suppkey % 13 = 0 THEN '' ELSE p_name || ' ' || CAST(p_partkey AS VARCHAR) END AS stem,
    CASE WHEN l_partkey % 11 = 10 THEN 'Z' WHEN l_partkey % 11 < 4 THEN CAST(l_partkey % 11 + 1 AS VARCHAR) ELSE substr('ABCDEF', CAST(l_partkey % 11 - 3 AS BIGINT), 1) END AS key_raw,
    CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS review_status,
    CAST(l_quantity AS BIGINT) % 3 AS n_warnings, l_partkey AS part_key, p_name AS name
  FROM lines JOIN part ON l_partkey = p_partkey),
legend(key_raw, accepted) AS (VALUES ('1','A'),('2','B'),('3','C'),('4','D'),('A','AB'),('B','AC'),('C','AD'),('D','BC'),('E','BD'),('F','CD'),('Z','ABCD')),
letters(label) AS (VALUES ('A'),('B'),('C'),('D')),
options AS (
  SELECT question_id, paper_id, label,
    CASE WHEN part_key % 19 = 0 AND label = 'B' THEN '' WHEN part_key % 23 = 0 AND label = 'C' THEN '(3)' WHEN part_key % 7 = 0 AND label = 'D' THEN name || ' A' ELSE name || ' ' || label END AS text,
    contains(accepted, label) AND part_key % 31 <> 0 AS is_correct
  FROM questions JOIN legend USING (key_raw) CROSS JOIN letters WHERE NOT (part_key % 29 = 0 AND label = 'D')),
commands AS (
  SELECT event_id, CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 3 AS VARCHAR) AS attempt_id, user_id, epoch_us(ts) // 1000 AS ms,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS question_no, event_type,
    CASE WHEN event_type = 'click' THEN substr('ABCD', CAST(floor(value) AS BIGINT) % 4 + 1, 1) END AS chosen, CAST(floor(value * 100) AS BIGINT) AS time_ms
  FROM events),
responses AS (
  SELECT attempt_id, min(user_id) AS user_id, question_no,
    arg_max(CASE WHEN event_type = 'click' THEN chosen ELSE '' END, ms * 1000000 + event_id) FILTER (WHERE event_type IN ('click', 'error')) AS raw_chosen,
    max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS visited,
    coalesce(arg_max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END, ms * 1000000 + event_id) FILTER (WHERE event_type IN ('purchase', 'signup')), 0) AS marked,
    CAST(sum(time_ms) AS BIGINT) AS time_ms, max(ms) AS last_ms
  FROM commands GROUP BY attempt_id, question_no),
attempts AS (
  SELECT o_orderkey AS attempt_id, o_custkey AS user_id, o_orderpriority AS paper_type, o_orderkey % 40 AS paper_no, epoch_ms(o_orderdate) AS started_ms,
    CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(o_orderdate) + (o_orderkey % 90) * 60000 END AS submitted_ms,
    CASE WHEN o_orderstatus = 'P' THEN epoch_ms(o_orderdate) + 30000 END AS paused_ms,
    CAST(floor(o_totalprice) AS BIGINT) % 151 AS score, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 150 END AS max_score
  FROM orders),
mistakes AS (
  SELECT event_id AS mistake_id, user_id, question_no, ms AS created_ms, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'misread' ELSE 'conceptual' END AS mistake_type,
    CASE WHEN event_id % 5 = 0 THEN ms + 1000 END AS resolved_ms
  FROM commands WHERE event_type IN ('error', 'purchase')),
pool AS (
  SELECT CAST(p_partkey AS VARCHAR) AS question_id, p_type AS subject, p_brand AS topic_id, p_name || ' ' || CAST(p_partkey % 1500 AS VARCHAR) AS stem, p_size AS size FROM part),
docs AS (SELECT doc_id, text, lang, source FROM documents)
"""


class Tables:
    """Canonical tables of one folder of given ones."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def papers(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
        return self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("paper_id"), F.col("c_mktsegment").alias("exam_code"), F.col("o_orderpriority").alias("paper_type"), F.to_date("o_orderdate").alias("held_on"), status.alias("review_status"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("user_id")
        )

    @cached_property
    def questions(self) -> DataFrame:
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
        lines = self.raw("lineitem").repartition(self.parts, "l_orderkey").withColumn("pos", F.row_number().over(order).cast("long"))
        if self.parts > MANY_PARTS:
            # Parts are many as well then, and are joined by a shuffle.
            lines = lines.repartition(self.parts, "l_partkey")
        m = F.col("l_partkey") % 11
        return lines.join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_orderkey").alias("paper_id"),
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("pos").cast("string")).alias("question_id"),
            "pos",
            F.col("l_linenumber").cast("long").alias("number"),
            F.when(F.col("l_linestatus") == "O", "I").otherwise("II").alias("part"),
            F.when(F.col("l_partkey") % 17 != 0, F.col("p_type")).alias("subject"),
            F.when(F.col("l_partkey") % 5 != 0, F.col("p_brand")).alias("topic_id"),
            F.when(F.col("l_suppkey") % 13 == 0, "").otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("stem"),
            F.when(m == 10, "Z").when(m < 4, (m + 1).cast("string")).otherwise(F.substr(F.lit("ABCDEF"), (m - 3).cast("int"), F.lit(1))).alias("key_raw"),
            F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "R", "rejected").otherwise("pending").alias("review_status"),
            (F.col("l_quantity").cast("long") % 3).alias("n_warnings"),
            F.col("l_partkey").alias("part_key"),
            F.col("p_name").alias("name"),
        )

    @cached_property
    def parts(self) -> int:
        """Parts in which questions are dealt: their number grows with the table, so that what a task holds does not."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.raw("lineitem").count() // PART_ROWS))

    def dealt(self, *keys: str) -> DataFrame:
        """The questions dealt by keys: what groups or joins by them moves no row again."""
        return self.questions.repartition(self.parts, *keys)

    @cached_property
    def options(self) -> DataFrame:
        """Dealt by question before there are four rows of each, as its options are what is grouped."""
        return options_of(self.dealt("question_id"))

    @cached_property
    def commands(self) -> DataFrame:
        return commands(self.raw("events"))

    @cached_property
    def responses(self) -> DataFrame:
        from quillspark.streaming import fold_responses

        return fold_responses(self.commands)

    @cached_property
    def attempts(self) -> DataFrame:
        ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
        return self.raw("orders").select(
            F.col("o_orderkey").alias("attempt_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("paper_type"), (F.col("o_orderkey") % 40).alias("paper_no"), ms.alias("started_ms"),
            F.when(F.col("o_orderstatus") != "O", ms + (F.col("o_orderkey") % 90) * 60000).alias("submitted_ms"),
            F.when(F.col("o_orderstatus") == "P", ms + 30000).alias("paused_ms"),
            (F.floor("o_totalprice").cast("long") % 151).alias("score"), F.when(F.col("o_orderkey") % 50 == 0, 0).otherwise(150).alias("max_score"),
        )

    @cached_property
    def mistakes(self) -> DataFrame:
        e = F.col("event_id")
        return self.commands.filter(F.col("event_type").isin("error", "purchase")).select(e.alias("mistake_id"), "user_id", "question_no", F.col("ms").alias("created_ms"), F.when(e % 7 != 0, F.when(e % 2 == 0, "misread").otherwise("conceptual")).alias("mistake_type"), F.when(e % 5 == 0, F.col("ms") + 1000).alias("resolved_ms"))

    @cached_property
    def pool(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(k.cast("string").alias("question_id"), F.col("p_type").alias("subject"), F.col("p_brand").alias("topic_id"), F.concat_ws(" ", "p_name", (k % 1500).cast("string")).alias("stem"), F.col("p_size").alias("size"))

    @cached_property
    def docs(self) -> DataFrame:
        return self.raw("documents").select("doc_id", "text", "lang", "source")


#: Questions of a part.
PART_ROWS = 250_000
MANY_PARTS = 64


def option(label: Column) -> tuple[Column, Column, Column]:
    """Of a question's option of a label: text, whether it is correct, and whether it is there."""
    k = F.col("part_key")
    text = F.when((k % 19 == 0) & (label == "B"), "").when((k % 23 == 0) & (label == "C"), "(3)").when((k % 7 == 0) & (label == "D"), F.concat("name", F.lit(" A"))).otherwise(F.concat_ws(" ", "name", label))
    return text, F.array_contains(accepted(F.col("key_raw")), label) & (k % 31 != 0), ~((k % 29 == 0) & (label == "D"))


def options_of(questions: DataFrame) -> DataFrame:
    """A row for each option of the questions, which stay where they are dealt."""
    text, right, there = option(F.col("label"))
    every = questions.withColumn("label", F.explode(F.array(*map(F.lit, KEY_LEGEND["Z"])))).filter(there)
    return every.select("question_id", "paper_id", "label", text.alias("text"), right.alias("is_correct"))


def option_list() -> Column:
    """A question's options, in order of label, in the question's own row."""
    each = [(F.lit(x), *option(F.lit(x))) for x in KEY_LEGEND["Z"]]
    return F.array_compact(F.array(*[F.when(there, F.struct(label.alias("label"), text.alias("text"), right.alias("is_correct"))) for label, text, right, there in each]))


def commands(events: DataFrame) -> DataFrame:
    """Events, at rest or streaming, as commands on an attempt's questions."""
    return events.select(
        "event_id", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 3).cast("string")).alias("attempt_id"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long").alias("question_no"), "event_type",
        F.when(F.col("event_type") == "click", F.substr(F.lit("ABCD"), (F.floor("value").cast("int") % 4) + 1, F.lit(1))).alias("chosen"), F.floor(F.col("value") * 100).cast("long").alias("time_ms"),
    )
