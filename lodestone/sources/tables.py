"""Sources and sinks: JSON lines, checkpoints, runs, tables and cached indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import evaluation, ingest

from .shared import shared_copy

CORPUS = "doc_id string, title string, text string, url string, wikidata_qid string, approx_tokens int"
QUESTION = "qid string, question string, qtype string, answer array<string>, gold_doc_ids array<string>, answer_named_in_question boolean, guess_baseline double, answer_verified boolean, v2_class string, class_note string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSON lines in file order, blank lines skipped, then ingest.corpus()."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n")).alias("ordinal"), F.from_json("value", CORPUS, {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")
    return ingest.corpus(rows)


def read_questions(spark: SparkSession, path: str, limit: int | None = None, classes: str | None = None) -> DataFrame:
    """Evaluation questions; `classes` is a comma list, case aside."""
    rows = spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path)
    if classes:
        rows = rows.where(F.upper("v2_class").isin([c.strip().upper() for c in classes.split(",") if c.strip()]))
    return rows.orderBy("qid").limit(limit) if limit else rows


def gold_documents(*questions: DataFrame) -> DataFrame:
    out = None
    for q in questions:
        one = q.select(F.explode("gold_doc_ids").alias("doc_id"))
        out = one if out is None else out.union(one)
    return out.distinct()


def read_checkpoint(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "qid") -> DataFrame:
    """JSON lines of finished work; broken lines are skipped, the last of a key wins."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("n", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")))
    rows = lines.select("n", F.from_json("value", schema).alias("r")).where(F.col(f"r.{key}").isNotNull()).select("n", "r.*")
    return ingest.last_wins(rows, key, "n").drop("n")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def save_run(run: DataFrame, path: str) -> None:
    """run documents as JSON by pipeline and eval_set."""
    run.write.mode("append").partitionBy("pipeline", "eval_set").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_predictions(runs: DataFrame, path: str) -> None:
    """All pipelines' predictions as CSV rows and as one JSON line for each pipeline."""
    rows = evaluation.predictions(runs)
    write_csv(rows, f"{path}/csv")
    rows.groupBy("pipeline").agg(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "pipeline"]))).alias("records")).write.mode("overwrite").json(f"{path}/json")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def ensure_table(spark: SparkSession, name: str, schema: str, reset: bool = False) -> None:
    """A Parquet table, created if it is missing; reset drops what is there."""
    if reset:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING PARQUET")


def missing_columns(have: T.StructType, want: T.StructType) -> list[str]:
    """Fields that a table lacks, in the wanted order."""
    names = {f.name for f in have.fields}
    return [f.name for f in want.fields if f.name not in names]


def top_up(spark: SparkSession, rows: DataFrame, table: str, key: str) -> int:
    """Append the rows whose key the table lacks, one of each key (the least by all its
    columns); how many. Columns go by name. Running it again adds none."""
    fresh = ingest.new_rows(rows, spark.table(table), key)
    # the table cannot be read and appended to in one plan: the new rows go through a copy
    copy = shared_copy(ingest.first_wins(fresh, key, *fresh.columns), "topup")
    n = copy.count()
    if n:
        copy.select(*spark.table(table).columns).write.mode("append").insertInto(table)
    return n


def chunk_scan(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """Stored chunks, of some documents if given: the filter reaches the scan."""
    rows = spark.read.parquet(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(list(doc_ids)))


def cached_index(spark: SparkSession, path: str, live: DataFrame, build) -> DataFrame:
    """The index stored at path; built again if it is missing or the live rows are more
    than those it was built from. build(live) gives the index."""
    n, root = live.count(), path.rstrip("/")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/count")
    there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
    if not there or is_stale(n, spark.read.parquet(f"{root}/count").first()["n"]):
        build(live).write.mode("overwrite").parquet(f"{root}/index")
        spark.createDataFrame([(n,)], "n long").write.mode("overwrite").parquet(f"{root}/count")
    return spark.read.parquet(f"{root}/index")


def is_stale(live_count: int, cached_count: int) -> bool:
    return live_count > cached_count
