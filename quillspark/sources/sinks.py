"""Writing the gated bundle and work lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.folders import written


def bundle_papers(papers: DataFrame, questions: DataFrame, full: bool = True) -> DataFrame:
    """papers with approved and total counts, and why a paper is skipped (null: shipped)."""
    counts = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("review_status") == "approved").alias("approved"))
    rows = papers.join(counts, "paper_id", "left").na.fill(0, ["total", "approved"])
    reason = F.when(F.col("approved") == 0, "nothing approved").when(F.lit(full) & (F.col("approved") < F.col("total")), F.concat(F.col("approved").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" approved")))
    return rows.withColumn("reason", reason)


def checksum(df: DataFrame) -> DataFrame:
    """A checksum that does not depend on the order of rows."""
    return df.agg(F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("checksum"), F.count(F.lit(1)).alias("rows"))


def export_bundle(papers: DataFrame, questions: DataFrame, options: DataFrame, path: str, full: bool = True) -> dict:
    """Write papers, questions, options and meta of what ships, as Parquet by exam; returns counts and skipped reasons."""
    # Read four times from here on.
    judged = written(bundle_papers(papers, questions, full), "judged")
    ship = judged.filter("reason is null").select(*papers.columns, F.col("approved").alias("total_questions"))
    kept = questions.filter(F.col("review_status") == "approved").join(ship.select("paper_id", "exam_code"), "paper_id")
    spark = papers.sparkSession
    write = lambda df, name: df.write.mode("overwrite").partitionBy("exam_code").parquet(f"{path}/{name}")
    write(ship, "papers")
    write(kept, "questions")
    # What ships is read back, not found again.
    shipped = spark.read.schema(kept.schema).parquet(f"{path}/questions")
    write(options.join(shipped.select("question_id", "exam_code"), "question_id"), "options")
    sums = {name: checksum(spark.read.parquet(f"{path}/{name}")).first() for name in ("papers", "questions", "options")}
    meta = [("gate", "approved"), ("full", str(full).lower()), *[(f"{n}_{k}", str(r[k])) for n, r in sums.items() for k in ("rows", "checksum")]]
    spark.createDataFrame(meta, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    skipped = {r["why"]: r["n"] for r in judged.filter("reason is not null").groupBy(F.regexp_replace("reason", "[0-9]+", "n").alias("why")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {"rows": {n: r["rows"] for n, r in sums.items()}, "skipped": skipped}


def write_report(rows: DataFrame, path: str, texts: list[str], most: int = 400) -> None:
    """A work list as JSON lines, with long texts cut for reading."""
    rows.withColumns({c: F.substring(c, 1, most) for c in texts}).write.mode("overwrite").json(path)
