"""Scoring of answers, rollups and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx

CORE_METRICS = ("total_ms", "llm_calls", "input_tokens", "output_tokens", "total_tokens", "llm_latency_ms", "retrieval_ms", "chunks", "evidence_sufficient", "confidence", "citations")
#: Metrics that each pipeline adds to the core ones.
EXTRA_METRICS = {"vector": (), "graph": ("retrieval_mode", "scope_coverage"), "agentic": ("steps", "contexts_investigated")}


def answer_match(predicted: Column, golds: Column) -> Column:
    """Equal after normalising, or contained: anywhere if the gold has over three
    characters, as whole words if not."""
    p = tx.normalize_answer(predicted)

    def one(g):
        inside = F.contains(p, g) & (F.length(g) > 3)
        whole = F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" ")))
        return (g != "") & ((p == g) | inside | whole)

    return F.exists(F.transform(F.coalesce(golds, F.array().cast("array<string>")), tx.normalize_answer), one)


def gold_coverage(retrieved: Column, gold: Column) -> Column:
    """Share of the gold documents that were retrieved; null without gold."""
    g = F.array_distinct(gold)
    return F.when(F.size(g) > 0, F.size(F.array_intersect(F.array_distinct(retrieved), g)) / F.size(g))


def eval_summary(records: DataFrame) -> DataFrame:
    """records(answer_match, error, tokens, ms) -> one row; accuracy with and
    without the questions that failed in the denominator."""
    ok = F.col("error").isNull()
    hit = F.when(F.col("answer_match"), 1.0).otherwise(0.0)
    return records.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"), F.round(F.avg(hit), 4).alias("accuracy_all"), F.round(F.avg(F.when(ok, hit)), 4).alias("accuracy_ok"), F.round(F.avg(F.when(ok, F.col("tokens"))), 2).alias("avg_tokens"), F.round(F.avg(F.when(ok, F.col("ms"))), 2).alias("avg_ms"))


def class_rollup(records: DataFrame, cls: str) -> DataFrame:
    """n, correct and accuracy of each class, and of all as class 'total'."""
    rows = records.rollup(cls).agg(F.count("*").alias("n"), F.count_if("answer_match").alias("correct"), F.grouping(cls).alias("g"))
    return rows.select(F.when(F.col("g") == 1, "total").otherwise(F.coalesce(F.col(cls).cast("string"), F.lit("unknown"))).alias("class"), "n", "correct", F.round(F.col("correct") / F.col("n"), 4).alias("accuracy"))


def qtype_pivot(records: DataFrame, pipelines: list[str]) -> DataFrame:
    """Accuracy by question type, a column for each pipeline."""
    hit = F.when(F.col("answer_match"), 1.0).otherwise(0.0)
    rows = records.withColumn("qtype", F.coalesce("qtype", F.lit("unknown"))).groupBy("qtype").pivot("pipeline", pipelines).agg(F.round(F.avg(hit), 4))
    return rows


def latency_split(timings: DataFrame, llm_stages: tuple[str, ...]) -> DataFrame:
    """timings(pipeline, qid, stage, ms) -> mean and median total, retrieval and
    model time of each pipeline's questions."""
    llm = F.col("stage").isin(*llm_stages)
    per = timings.groupBy("pipeline", "qid").agg(F.sum("ms").alias("total"), F.sum(F.when(llm, F.col("ms")).otherwise(0.0)).alias("llm"))
    return per.groupBy("pipeline").agg(F.count("*").alias("n"), F.round(F.avg("total"), 6).alias("mean_ms"), F.round(F.percentile("total", F.lit(0.5)), 6).alias("median_ms"), F.round(F.avg(F.col("total") - F.col("llm")), 6).alias("retrieval_ms"), F.round(F.avg("llm"), 6).alias("llm_ms"))


def metrics_summary(rows: DataFrame) -> DataFrame:
    """rows(name, value) -> count, total and average (2 places) of each timer."""
    return rows.groupBy("name").agg(F.count("*").alias("count"), F.round(F.sum("value"), 2).cast("double").alias("total"), F.round(F.avg("value"), 2).cast("double").alias("avg"))


def metrics_contract(metrics: Column, pipeline: str) -> Column:
    """Names that a map of metrics lacks or holds null for: struct(core, extra)."""
    lack = lambda names: F.filter(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), lambda k: F.element_at(metrics, k).isNull())
    return F.struct(lack(CORE_METRICS).alias("core"), lack(EXTRA_METRICS[pipeline]).alias("extra"))


def newest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each (pipeline, eval_set) by stamp."""
    return runs.groupBy("pipeline", "eval_set").agg(F.max_by(F.struct(*[c for c in runs.columns if c not in ("pipeline", "eval_set")]), "stamp").alias("r")).select("pipeline", "eval_set", "r.*")


def predictions(runs: DataFrame) -> DataFrame:
    """runs(pipeline, records array<struct>) -> one flat row per question."""
    return runs.select("pipeline", F.explode("records").alias("r")).select("pipeline", "r.*")


def llm_totals(calls: DataFrame, *keys: str) -> DataFrame:
    """calls(input_tokens, output_tokens, ms) -> per key: calls, tokens and latency."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.round(F.sum("ms"), 2).cast("double").alias("latency_total_ms"))


def agent_summary(results: DataFrame) -> DataFrame:
    """investigate.assemble() rows -> one row: questions, steps a question, share of those
    that changed their strategy, tokens a step."""
    return results.agg(F.count("*").alias("n"), F.round(F.avg("steps"), 2).alias("avg_steps"), F.round(F.avg(F.col("strategy_changed").cast("int")), 4).alias("strategy_change_rate"), F.round(F.sum("tokens") / F.sum("steps"), 2).alias("tokens_per_op"))


def time_per_tool(trace: DataFrame) -> DataFrame:
    """trace(qid, tool, ms, tokens) -> per question and tool: calls, time and tokens a call."""
    return trace.groupBy("qid", "tool").agg(F.count("*").alias("calls"), F.sum("ms").cast("double").alias("ms"), F.round(F.sum("tokens") / F.count("*"), 2).alias("tokens_per_op"))


def question_types(records: DataFrame, questions: DataFrame) -> DataFrame:
    """records(qid, qtype?) with the type of their question, their own where there is none,
    else 'unknown'."""
    known = questions.select("qid", F.col("qtype").alias("_asked")).dropDuplicates(["qid"])
    return records.join(known, "qid", "left").withColumn("qtype", F.coalesce("_asked", "qtype", F.lit("unknown"))).drop("_asked")
