"""Loading parsed papers, manifests, path metadata; schema alignment; snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.operators.numbering import numbered

OPTION = "struct<label:string,text:map<string,string>,isCorrect:boolean>"
PARSED = (
    "paper struct<id:string,examCode:string,paperType:string,heldOn:string,totalQuestions:int>, "
    f"questions array<struct<id:string,number:int,part:string,subject:string,stem:map<string,string>,keyRaw:string,warnings:array<string>,options:array<{OPTION}>>>, _corrupt_record string"
)


def load_parsed(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, questions, options) of parsed-paper documents, all pending; malformed documents are skipped."""
    raw = spark.read.schema(PARSED).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = raw.filter(F.col("paper.id").isNotNull() & F.col("_corrupt_record").isNull())
    papers = good.select(F.col("paper.id").alias("paper_id"), F.col("paper.examCode").alias("exam_code"), F.col("paper.paperType").alias("paper_type"), F.col("paper.heldOn").alias("held_on"), F.col("paper.totalQuestions").alias("total_questions"), F.lit("pending").alias("review_status"))
    q = good.select(F.col("paper.id").alias("paper_id"), F.posexplode("questions").alias("pos", "q"))
    questions = q.select("paper_id", F.col("q.id").alias("question_id"), F.col("q.number").alias("number"), F.col("q.part").alias("part"), F.col("q.subject").alias("subject"), F.try_element_at("q.stem", F.lit("en")).alias("stem_en"), F.try_element_at("q.stem", F.lit("hi")).alias("stem_hi"), F.col("q.keyRaw").alias("key_raw"), F.size(F.coalesce("q.warnings", F.array())).cast("long").alias("n_warnings"), F.lit("pending").alias("review_status"))
    options = q.select(F.col("q.id").alias("question_id"), F.explode("q.options").alias("o")).select("question_id", F.col("o.label").alias("label"), F.try_element_at("o.text", F.lit("en")).alias("text_en"), F.coalesce("o.isCorrect", F.lit(False)).alias("is_correct"))
    return papers, questions, options


MANIFEST = "code string, klass int, subject string, note string, url string, ok boolean"


def load_manifest(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A manifest in CSV or JSON, with a title: the note, else the subject."""
    reader = spark.read.schema(MANIFEST)
    raw = reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)
    return raw.withColumn("title", F.coalesce(F.nullif(F.trim("note"), F.lit("")), "subject"))


def scan_paths(rows: DataFrame, path: str) -> DataFrame:
    """Parts of a path: host, first folder, file stem and number, and the language its second letter names; others are left out."""
    shape = r"^[a-z]+://([^/]+)/([a-z]+)/([A-Za-z]*)([0-9]+)"
    part = lambda i: F.regexp_extract(path, shape, i)
    medium = F.when(F.substring(part(2), 2, 1) == "n", "english").when(F.substring(part(2), 2, 1) == "e", "german").otherwise("other")
    return rows.filter(F.col(path).rlike(shape)).withColumns({"host": part(1), "folder": part(2), "stem": part(3), "number": part(4).cast("long"), "medium": medium})


def choose_main(files: DataFrame, folder: str, name: str) -> DataFrame:
    """The main file of each folder: one of the wanted spelling, else one that is no language supplement; none otherwise."""
    wanted, supplement = F.col(name).rlike("(?i)main|index|top"), F.col(name).rlike("(?i)lang|page=")
    best = F.struct(F.when(wanted, 0).otherwise(1).alias("rank"), F.col(name).alias("name"))
    return files.filter(wanted | ~supplement).groupBy(folder).agg(F.min(best).alias("b")).select(folder, F.col("b.name").alias("main"), (F.col("b.rank") == 0).alias("named"))


_ORDER = ["byte", "short", "integer", "long", "float", "double", "string"]


def align_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """df with the target's columns: missing ones null, narrower ones widened, wider ones kept, unknown ones dropped."""
    have = {f.name: f.dataType for f in df.schema.fields}

    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        own, new = have[f.name].typeName(), f.dataType.typeName()
        narrower = own in _ORDER and new in _ORDER and _ORDER.index(new) < _ORDER.index(own)
        return F.col(f.name) if narrower else F.col(f.name).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in target.fields])


NAMES = ("attempts", "responses", "mistakes")


def pack_snapshot(attempts: DataFrame, responses: DataFrame, mistakes: DataFrame, most: int = 10_000) -> DataFrame:
    """account, part (from 0), payload and counts: an account's three tables as JSON documents of at most ``most`` rows of each.

    Tables: account, then their own columns, by which rows are in order. An account of few rows is one document; of many, several,
    and its rows are numbered over ranges, so no task holds them all. Rows without an account belong to nobody and stay out."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        own = [c for c in df.columns if c != "account"]
        rows = numbered(df.filter("account is not null"), ["account", *own], "_n")
        first = rows.groupBy("account").agg(F.min("_n").alias("_first"))
        part = F.floor((F.col("_n") - F.col("_first")) / most).cast("int")
        return rows.join(first, "account").groupBy("account", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct(*own))).alias(name))

    keys = ["account", "part"]
    both = packed(attempts, "attempts").join(packed(responses, "responses"), keys, "full").join(packed(mistakes, "mistakes"), keys, "full")
    count = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}")
    return both.select(*keys, F.to_json(F.struct(*NAMES), {"ignoreNullFields": "false"}).alias("payload"), *[count(c) for c in NAMES])


def index_snapshots(snapshots: DataFrame) -> DataFrame:
    """A row for each account: its parts and what they count."""
    return snapshots.groupBy("account").agg(F.count(F.lit(1)).alias("parts"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in NAMES])


def unpack_snapshot(snapshots: DataFrame, index: DataFrame, table: str, schema: str) -> DataFrame:
    """One of the three tables back from the documents of accounts whose parts are all there; fields outside the schema are dropped.

    An account with a part missing, twice or not in the index gives no rows: half a history must not replace a whole one."""
    there = snapshots.groupBy("account").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("part").alias("_parts"), F.max("part").alias("_last"))
    whole = there.join(index.select("account", "parts"), "account").filter("_rows = parts and _parts = parts and _last = parts - 1").select("account")
    parsed = F.from_json("payload", f"{table} array<struct<{schema}>>")
    return snapshots.join(whole, "account", "left_semi").select("account", F.explode(parsed[table]).alias("r")).select("account", "r.*")
