"""From raw documents to packed training bins: five stages, each over all that the one before kept.

For all stages: only the columns of documents are read and passed on, so columns of other names cannot clash; an empty table
gives an empty one; null ids are ids like others; a null source or language is a value of its own; labels count by id.

* quality rules: null and empty texts have too few words and go; repeated rows share their fate.
* n-gram Jaccard join: rows that are the same in id and text count once; of linked rows the one of the least hash of id and
  text stays, so a repeated id decides nothing.
* secret scans: rows stay, texts and n_chars change where secrets are.
* mixing: texts without words are not taken; rows that are the same in id and text are taken together.
* packing: pieces of equal texts lie in different bins; a text without words has a row without a bin.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import mixing, ngram_join, packing, quality, secrets
from quillspark.llm.base import read, shelf, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or a risk-controlled threshold reject go."""
    judged = quality.judge(docs, read(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*COLUMNS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in a text is replaced by a mask; n_chars follows."""
    masked = secrets.scan(docs).withColumn("text", F.when(F.size("secret_spans") > 0, secrets.redact(F.col("text"), F.col("secret_spans"))).otherwise(F.col("text")))
    return masked.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, one stays; rows that are the same count once."""
    rows = docs.select(*COLUMNS).withColumn("_row", F.xxhash64("doc_id", "text"))
    found = ngram_join.join_documents(rows, doc_id="_row")
    keep = stored(found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct(), "near-duplicates")
    return rows.join(keep, F.col("_row") == F.col("_kept"), "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    times = (F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    return mixing.mix(docs).filter("taken > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), times))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins; a document taken twice lies in two bins."""
    return packing.pack_documents(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]
#: None: which documents link is not expressed in SQL at this scale; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote on its way goes once it is done."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with shelf(spark) as tables:
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept = tables.pop()
            if before:
                tables.append(before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
