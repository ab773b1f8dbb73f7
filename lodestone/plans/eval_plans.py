"""Queries over evaluation, reports and the investigation loop, and their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation, ingest, investigate

from . import fixtures as fx
from . import sql


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir):
    rows = fx.view(spark, sf_dir, fx.RECORDS, "events")
    return rows.select("qid", "qtype", "pipeline", F.col("hit").alias("answer_match"), F.col("err").alias("error"), (F.col("event_id") % 1000).alias("tokens"), "ms")


def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as answers, part of the first turn as gold."""
    c = _table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("f"))
    # the second gold ends at a space: lines and tabs are part of it
    golds = F.array(F.substring("f", 1, 12), F.regexp_extract("f", r"^[^ ]+", 0), F.lit(""))
    asked = F.exists(golds, lambda g: tx.normalize_answer(g) != "")
    match = evaluation.answer_match(F.col("text"), golds)
    # as in SQL, unknown without a first turn, and without a text that there is a gold for
    known = F.col("f").isNotNull() & (F.col("text").isNotNull() | ~asked)
    return c.join(first, "conv_id").select("conv_id", "turn", F.when(known, match).alias("match"))


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of an order's first lines as retrieved, of all lines as gold."""
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") <= 2, F.col("l_suppkey"))).alias("got"), F.collect_list(F.when(F.col("l_returnflag") != "N", F.col("l_suppkey"))).alias("gold"))
    return rows.select("l_orderkey", F.round(evaluation.gold_coverage(F.col("got"), F.col("gold")), 6).alias("coverage"))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.eval_summary(_records(spark, sf_dir))


def class_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_rollup(_records(spark, sf_dir), "qtype")


def qtype_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.qtype_pivot(_records(spark, sf_dir), ["vector", "graph", "agentic"])


def latency_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumnRenamed("qtype", "stage")
    return evaluation.latency_split(rows, ("click", "purchase"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.metrics_summary(_records(spark, sf_dir).select(F.col("qtype").alias("name"), F.round("ms", 2).cast("decimal(18,2)").alias("value")))


def metrics_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' values under the names of the contract."""
    names = [*evaluation.CORE_METRICS, "steps"]
    value = lambda i, n: F.when(F.col("c_custkey") % (i + 2) != 0, F.lit(n))
    metrics = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[value(i, n) for i, n in enumerate(names)]))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", evaluation.metrics_contract(metrics, "agentic").alias("m"))
    return rows.select("c_custkey", F.array_join("m.core", "|").alias("core"), F.array_join("m.extra", "|").alias("extra"))


def newest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pipeline"), F.col("o_orderstatus").alias("eval_set"), F.struct("o_orderdate", "o_orderkey").alias("stamp"), F.col("o_orderkey").alias("run_id"))
    return evaluation.newest_runs(runs).select("pipeline", "eval_set", "run_id")


def resume_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _records(spark, sf_dir).where("error is null").select("qid")
    return ingest.new_rows(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid")), done, "qid")


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators import graph

    stored = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    fresh = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")).where("s_suppkey % 3 = 0")
    return graph.upsert(stored, fresh, ["s_suppkey"])


def prediction_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).where("error is null")
    runs = rows.groupBy("pipeline", "qid").agg(F.collect_list(F.struct("qid", "tokens", "answer_match")).alias("records")).select("pipeline", "records")
    return evaluation.predictions(runs).groupBy("pipeline", "qid").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of documents without the entries that have no value."""
    d = _table(spark, sf_dir, "documents")
    entries = F.create_map(F.lit("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.lit("source"), F.col("source"), F.lit("url"), F.lit(None).cast("string"))
    return d.select("doc_id", F.array_join(F.array_sort(F.map_keys(ingest.scalars_only(entries))), "|").alias("names"))


def _state(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (k % len(names)).cast("int"))
    return _table(spark, sf_dir, "orders").select(
        k.alias("qid"), (k % 7).cast("int").alias("step"), (k % 5).cast("int").alias("graph_calls"), (k % 4).cast("int").alias("scope_calls"), (k % 3).cast("int").alias("vector_calls"), (k % 2).cast("int").alias("community_calls"),
        pick(["GRAPH_SEARCH", "GRAPH_SCOPE", "VECTOR_SEARCH", "COMMUNITY_SEARCH", "STOP", "DANCE"]).alias("proposal"), pick(["all_slots_supported", "weird_reason", "max_steps", "", "ran_out_of_steps"]).alias("reason"),
        F.lit("b").alias("target"), F.array(F.lit("a"), F.lit("b")).alias("candidates"), F.when(k % 9 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 9 < 4, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("investigated"),
    )


def supervisor_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigate.decide(_state(spark, sf_dir)).select("qid", "action", "reason_code", "target_context")


def evidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("qid"), F.col("l_linenumber").cast("int").alias("step"), (F.col("l_partkey") % 50).cast("string").alias("chunk_id"), F.when(F.col("l_suppkey") % 5 > 0, (F.col("l_suppkey") % 40).cast("string")).alias("event_id"))
    out = investigate.evidence_stats(rows)
    return out.select("qid", "step", *[F.col(c).cast("long").alias(c) for c in ("total_chunks", "distinct_chunks", "distinct_events", "new_chunks")], "gain")


def slot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    slots = c.select(F.col("conv_id").alias("qid")).distinct().select("qid", F.explode(F.array(F.lit("user"), F.lit("assistant"), F.lit("system"))).alias("slot"))
    verdicts = c.select(F.col("conv_id").alias("qid"), F.col("role").alias("slot"), F.col("turn").alias("round"), F.when(F.col("turn") % 2 == 0, "supported").otherwise("partial").alias("status"))
    return investigate.slot_status(slots, verdicts)


def context_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*every))
    l = _table(spark, sf_dir, "lineitem").withColumn("copy", copy)
    rows = l.select((F.col("l_orderkey") % 200).alias("qid"), (F.col("l_partkey") % 30).cast("string").alias("chunk_id"), (F.col("l_suppkey") % 6).alias("support"), (F.col("l_quantity") % 10).alias("rerank_score"), F.when(F.col("l_suppkey") % 3 == 0, "graph").otherwise("dense").alias("source"), F.repeat(F.col("l_returnflag"), F.lit(1500)).alias("text"), F.struct("l_orderkey", "l_linenumber", "copy").alias("ord"))
    out = investigate.build_context(rows)
    return out.select("qid", "chunk_id", "support", "source", "rerank_score", F.length("text").cast("long").alias("chars"), F.col("position").cast("long").alias("position"), "duplicates")


def result_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    tool = F.get(F.array(*[F.lit(a) for a in investigate.ACTIONS]), (F.col("event_id") % 6).cast("int"))
    out = investigate.assemble(e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("step"), tool.alias("tool"), F.round("value", 2).cast("decimal(18,2)").alias("ms"), (F.col("event_id") % 100).alias("tokens")))
    return out.withColumn("ms", F.col("ms").cast("double"))


def citation_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    chunks = F.array(F.lit("c1"), F.lit("c2"), F.lit("c3"))
    cites = F.array((F.col("o_orderkey") % 5).cast("string"), F.col("o_orderstatus"))
    return o.select("o_orderkey", F.array_join(investigate.cite(cites, chunks), "|").alias("cited"))


def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("position"), tx.shorten(F.col("text"), 1400, " …").alias("text"))
    return investigate.prompt_blocks(c)


QUERIES = {f.__name__: f for f in (answer_match, gold_coverage, eval_summary, class_rollup, qtype_pivot, latency_split, metrics_summary, metrics_contract, newest_run, resume_checkpoint, upsert_latest, prediction_export, supervisor_policy, evidence_stats, slot_status, context_builder, result_assembly, citation_remap, prompt_assembly, metadata_scalars)}

_REC = f"rec AS (SELECT qid, qtype, pipeline, hit AS answer_match, err AS error, event_id % 1000 AS tokens, ms FROM ({fx.duck(fx.RECORDS)}))"
_N = [*evaluation.CORE_METRICS, "steps"]
_LACK = "[" + ", ".join(f"CASE WHEN c_custkey % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(_N[:-1])) + "]"
_POLICY = """
WITH s AS (SELECT o_orderkey AS qid, o_orderkey % 7 AS step, o_orderkey % 5 AS g, o_orderkey % 4 AS sc, o_orderkey % 3 AS v, o_orderkey % 2 AS c,
  ['GRAPH_SEARCH', 'GRAPH_SCOPE', 'VECTOR_SEARCH', 'COMMUNITY_SEARCH', 'STOP', 'DANCE'][(o_orderkey % 6) + 1] AS p, ['all_slots_supported', 'weird_reason', 'max_steps', '', 'ran_out_of_steps'][(o_orderkey % 5) + 1] AS reason,
  CASE WHEN o_orderkey % 9 = 0 THEN [] WHEN o_orderkey % 9 < 4 THEN ['a'] ELSE ['a', 'b'] END AS left_ FROM orders),
t AS (SELECT *, CASE p WHEN 'GRAPH_SEARCH' THEN g < 3 WHEN 'GRAPH_SCOPE' THEN sc < 2 WHEN 'VECTOR_SEARCH' THEN v < 2 ELSE c < 1 END AS ok FROM s),
d AS (SELECT *, CASE WHEN step >= 5 OR p IN ('STOP', 'DANCE') OR (p = 'GRAPH_SCOPE' AND len(left_) = 0) THEN 'STOP' WHEN ok THEN p
  WHEN p <> 'VECTOR_SEARCH' AND v < 2 THEN 'VECTOR_SEARCH' WHEN p <> 'GRAPH_SEARCH' AND g < 3 THEN 'GRAPH_SEARCH' WHEN p <> 'GRAPH_SCOPE' AND sc < 2 AND len(left_) > 0 THEN 'GRAPH_SCOPE' WHEN p <> 'COMMUNITY_SEARCH' AND c < 1 THEN 'COMMUNITY_SEARCH' ELSE 'STOP' END AS action FROM t)
SELECT qid, action, CASE WHEN step >= 5 THEN 'budget_exhausted' WHEN p = 'DANCE' THEN 'no_useful_path'
  WHEN p = 'STOP' THEN CASE reason WHEN 'all_slots_supported' THEN 'sufficient_evidence' WHEN 'max_steps' THEN 'budget_exhausted' WHEN 'ran_out_of_steps' THEN 'budget_exhausted' ELSE 'no_useful_path' END
  WHEN p = 'GRAPH_SCOPE' AND len(left_) = 0 THEN 'diminishing_returns' WHEN action = 'STOP' THEN 'budget_exhausted' ELSE reason END AS reason_code,
  CASE WHEN action = 'GRAPH_SCOPE' THEN CASE WHEN p = 'GRAPH_SCOPE' AND list_contains(left_, 'b') THEN 'b' ELSE left_[1] END END AS target_context FROM d
"""

SQL = {
    "answer_match": f"""WITH f AS (SELECT conv_id, min(text) AS f FROM conversations WHERE turn = 0 GROUP BY 1), g AS (SELECT conv_id, turn, {sql.answer('text')} AS p, {sql.answer('left(f, 12)')} AS g1, {sql.answer("regexp_extract(f, '^[^ ]+')")} AS g2 FROM conversations JOIN f USING (conv_id))
      SELECT conv_id, turn, (g1 <> '' AND ((length(g1) > 3 AND contains(p, g1)) OR contains(concat(' ', p, ' '), concat(' ', g1, ' ')))) OR (g2 <> '' AND ((length(g2) > 3 AND contains(p, g2)) OR contains(concat(' ', p, ' '), concat(' ', g2, ' ')))) AS match FROM g""",
    "gold_coverage": "WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) FILTER (l_linenumber <= 2) AS got, list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N') AS gold FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN len(gold) > 0 THEN round(coalesce(len(list_intersect(got, gold)), 0)::DOUBLE / len(gold), 6) END AS coverage FROM g",
    "eval_summary": f"WITH {_REC} SELECT count(*) AS n, count_if(error IS NULL)::BIGINT AS n_ok, round(avg(answer_match::INT), 4) AS accuracy_all, round(avg(answer_match::INT) FILTER (error IS NULL), 4) AS accuracy_ok, round(avg(tokens) FILTER (error IS NULL), 2) AS avg_tokens, round(avg(ms) FILTER (error IS NULL), 2) AS avg_ms FROM rec",
    "class_rollup": f"WITH {_REC} SELECT coalesce(qtype, 'total') AS class, count(*) AS n, count_if(answer_match)::BIGINT AS correct, round(count_if(answer_match) / count(*), 4) AS accuracy FROM rec GROUP BY ROLLUP (qtype)",
    "qtype_pivot": f"WITH {_REC} SELECT qtype, round(avg(answer_match::INT) FILTER (pipeline = 'vector'), 4) AS vector, round(avg(answer_match::INT) FILTER (pipeline = 'graph'), 4) AS graph, round(avg(answer_match::INT) FILTER (pipeline = 'agentic'), 4) AS agentic FROM rec GROUP BY 1",
    "latency_split": f"WITH {_REC}, p AS (SELECT pipeline, qid, sum(ms) AS total, sum(CASE WHEN qtype IN ('click', 'purchase') THEN ms ELSE 0 END) AS llm FROM rec GROUP BY 1, 2) SELECT pipeline, count(*) AS n, round(avg(total), 6) AS mean_ms, round(quantile_cont(total, 0.5), 6) AS median_ms, round(avg(total - llm), 6) AS retrieval_ms, round(avg(llm), 6) AS llm_ms FROM p GROUP BY 1",
    "metrics_summary": f"WITH {_REC} SELECT qtype AS name, count(*) AS count, round(sum(round(ms, 2)::DECIMAL(18, 2)), 2)::DOUBLE AS total, round(sum(round(ms, 2)::DECIMAL(18, 2))::DOUBLE / count(*), 2) AS avg FROM rec GROUP BY 1",
    "metrics_contract": f"SELECT c_custkey, array_to_string(list_filter({_LACK}, lambda x: x IS NOT NULL), '|') AS core, CASE WHEN c_custkey % {len(_N) + 1} = 0 THEN 'steps|contexts_investigated' ELSE 'contexts_investigated' END AS extra FROM customer",
    "newest_run": "SELECT o_orderpriority AS pipeline, o_orderstatus AS eval_set, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run_id FROM orders GROUP BY 1, 2",
    "resume_checkpoint": f"WITH {_REC} SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT qid FROM rec WHERE error IS NULL)",
    "upsert_latest": "SELECT c_custkey AS s_suppkey, c_name AS s_name FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)",
    "prediction_export": f"WITH {_REC} SELECT pipeline, qid, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM rec WHERE error IS NULL GROUP BY 1, 2",
    "metadata_scalars": "SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND lang IS NOT NULL THEN 'lang|source' ELSE 'source' END AS names FROM documents WHERE source IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND lang IS NOT NULL THEN 'lang' ELSE '' END FROM documents WHERE source IS NULL",
    "supervisor_policy": _POLICY,
    "evidence_stats": """WITH e AS (SELECT l_orderkey % 300 AS qid, l_linenumber AS step, l_partkey % 50 AS ch, CASE WHEN l_suppkey % 5 > 0 THEN l_suppkey % 40 END AS ev FROM lineitem),
      f AS (SELECT qid, ch, min(step) AS step FROM e GROUP BY 1, 2), h AS (SELECT qid, ev, min(step) AS step FROM e WHERE ev IS NOT NULL GROUP BY 1, 2), n AS (SELECT qid, step, count(*) AS rows FROM e GROUP BY 1, 2),
      p AS (SELECT qid, step, rows, coalesce(nc, 0) AS nc, coalesce(ne, 0) AS ne FROM n LEFT JOIN (SELECT qid, step, count(*) AS nc FROM f GROUP BY 1, 2) USING (qid, step) LEFT JOIN (SELECT qid, step, count(*) AS ne FROM h GROUP BY 1, 2) USING (qid, step))
      SELECT qid, step, sum(rows) OVER w::BIGINT AS total_chunks, sum(nc) OVER w::BIGINT AS distinct_chunks, sum(ne) OVER w::BIGINT AS distinct_events, nc::BIGINT AS new_chunks, CASE WHEN nc >= 3 THEN 'increasing' WHEN nc >= 1 THEN 'flat' ELSE 'diminishing' END AS gain FROM p WINDOW w AS (PARTITION BY qid ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    "slot_status": "WITH q AS (SELECT DISTINCT conv_id FROM conversations), s AS (SELECT conv_id, unnest(['user', 'assistant', 'system']) AS slot FROM q), v AS (SELECT conv_id, role AS slot, arg_max(CASE WHEN turn % 2 = 0 THEN 'supported' ELSE 'partial' END, turn) AS status FROM conversations GROUP BY 1, 2) SELECT conv_id AS qid, slot, coalesce(status, 'missing') AS status FROM s LEFT JOIN v USING (conv_id, slot)",
    "context_builder": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS copy FROM lineitem),
      r AS (SELECT l_orderkey % 200 AS qid, CAST(l_partkey % 30 AS VARCHAR) AS chunk_id, l_suppkey % 6 AS support, l_quantity % 10 AS rs, CASE WHEN l_suppkey % 3 = 0 THEN 'graph' ELSE 'dense' END AS source, (l_orderkey, l_linenumber, copy) AS o FROM l),
      m AS (SELECT qid, chunk_id, max(support) AS support, CASE WHEN bool_or(source = 'graph') THEN 'graph' ELSE 'dense' END AS source, arg_min(rs, o) AS rerank_score, count(*) AS hits, min(o) AS o FROM r GROUP BY 1, 2),
      p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, rerank_score DESC, o) AS position, sum(hits - 1) OVER (PARTITION BY qid)::BIGINT AS duplicates FROM m)
      SELECT qid, chunk_id, support, source, rerank_score, 1402::BIGINT AS chars, position, duplicates FROM p WHERE position <= 8""",
    "result_assembly": """WITH e AS (SELECT user_id AS qid, ['GRAPH_SEARCH', 'GRAPH_SCOPE', 'VECTOR_SEARCH', 'COMMUNITY_SEARCH', 'REFORMULATE', 'STOP'][(event_id % 6) + 1] AS tool, event_id % 100 AS tokens, round(value, 2)::DECIMAL(18, 2) AS ms FROM events)
      SELECT qid, count(*) AS steps, count(DISTINCT tool) FILTER (tool NOT IN ('REFORMULATE', 'STOP')) AS tools, count(DISTINCT tool) FILTER (tool NOT IN ('REFORMULATE', 'STOP')) > 1 AS strategy_changed, count_if(tool = 'REFORMULATE')::BIGINT AS reformulations, sum(tokens)::BIGINT AS tokens, sum(ms)::DOUBLE AS ms FROM e GROUP BY 1""",
    "citation_remap": "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 5 BETWEEN 1 AND 3 THEN concat('c', o_orderkey % 5) ELSE CAST(o_orderkey % 5 AS VARCHAR) END, '|', o_orderstatus) AS cited FROM orders",
    "prompt_assembly": "SELECT conv_id AS qid, string_agg(concat('[', turn + 1, '] ', CASE WHEN length(text) > 1400 THEN concat(left(text, 1400), ' …') ELSE text END), chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1",
}
