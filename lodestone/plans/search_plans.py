"""Queries over matching, graph search, loading, the tools and prompts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx
from lodestone.operators import evaluation, graph, ingest, investigate, load, matching, prompts, resolve, search, vectors
from lodestone.sources.shared import shared_copy

from . import eval_plans, fixtures as fx, graph_plans, sql, text_plans


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vec(rows, key, text, name):
    """rows with the hashed vector of a text."""
    v = vectors.hash_vectors(rows, key, text).select(F.col("id").alias(key), F.col("embedding").alias(name))
    return rows.join(v, key)


# -- matching --------------------------------------------------------------------
LONG_TAIL = "one two three four five six seven eight nine ten eleven twelve"


def _part_index(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("vtype"), F.col("p_partkey").cast("string").alias("vid"), F.col("p_name").alias("name"))
    return _vec(rows, "idx", tx.normalize_name(F.col("name")), "embedding")


def match_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts with an article, with a word twice, and in long mentions."""
    n, kind = F.col("p_name"), F.floor(F.col("p_partkey") / 50) % 4
    mention = F.when(kind == 0, F.concat(F.lit("The "), n)).when(kind == 1, F.concat_ws(" ", n, F.split_part(n, F.lit(" "), F.lit(1)))).when(kind == 2, F.concat_ws(" ", n, F.lit(LONG_TAIL))).otherwise(F.concat(F.repeat(F.concat(n, F.lit(" ")), F.lit(12)), F.lit(LONG_TAIL)))
    rows = _table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("qid"), F.lit(0).alias("mention_ord"), mention.alias("mention"))
    asked = _vec(rows, "qid", tx.normalize_name(F.col("mention")), "vec")
    found = shared_copy(matching.match_entities(asked, _part_index(spark, sf_dir)), "matched")
    none = matching.unmatched(asked, found).select("qid", F.lit(None).cast("string").alias("vid"), F.lit("none").alias("how"))
    return found.select("qid", "vid", F.when(F.col("how") == "exact", "exact").otherwise("fuzzy").alias("how")).unionByName(none)


def match_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer").select(F.col("ckey").alias("key")).distinct().withColumn("display", cx.key_display(F.col("key")))
    keys = _vec(keys, "key", tx.normalize_name(F.col("display")), "embedding")
    asked = fx.view(spark, sf_dir, fx.ASKED, "region").select("qid", F.when(F.col("qid") % 2 == 0, F.col("ckey")).otherwise(F.concat_ws(" and ", cx.key_display(F.col("ckey")), cx.key_display(F.col("ckey")), F.lit("games"))).alias("phrase"))
    found = matching.match_contexts(_vec(asked, "phrase", tx.normalize_name(F.col("phrase")), "vec"), keys)
    return found.select("qid", "phrase", "key", "display", F.when(F.col("how") == "exact", "exact").otherwise("fuzzy").alias("how"))


def entity_index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_type").alias("vtype"), F.col("p_partkey").cast("string").alias("vid"), F.concat(F.lit("The "), "p_name").alias("name"))
    return resolve.entity_index(parts).select(F.col("idx").cast("long").alias("idx"), "vtype", "vid", "norm")


# -- graph search ------------------------------------------------------------------
def _search(spark, sf_dir):
    """Customers by name; two thirds of them with two context phrases, half of them asking for a collection."""
    k = F.col("c_custkey")
    kind = F.when(k % 200 == 0, "collection_aggregation").otherwise("local_fact")
    phrases = F.when(F.floor(k / 100) % 3 != 1, F.array(F.lit("sport building"), F.lit("olympics:1996"))).otherwise(F.array().cast("array<string>"))
    people = _table(spark, sf_dir, "customer")
    q = people.where("c_custkey % 100 = 0").select(k.alias("qid"), F.lit("the of and is").alias("query"), kind.alias("question_type"), F.array("c_name").alias("mentions"), phrases.alias("phrases"))
    index = people.select(k.alias("idx"), F.lit("Person").alias("vtype"), k.cast("string").alias("vid"), F.col("c_name").alias("name"))
    members = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer").select(F.col("ckey").alias("key"), cx.key_display(F.col("ckey")).alias("display"), "vid")
    n = _table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    dense = q.select("qid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).join(F.broadcast(n)).select("qid", F.concat(((F.col("qid") + F.col("k")) % F.col("n")).cast("string"), F.lit("_chunk_0")).alias("chunk_id"), (F.col("k") + 1).cast("int").alias("rank"))
    edges = shared_copy(graph_plans._edges(spark, sf_dir), "edges")
    return search.graph_search(q, index, members, edges, graph_plans._chunk_texts(spark, sf_dir), dense)


def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).chunks.select("qid", "chunk_id", "source", F.col("position").cast("long").alias("position"))


def graph_search_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_seeds", "n_roots", "scope_events", "graph_chunks", "missing_chunks", "dense_topup", "final_chunks")
    return _search(spark, sf_dir).info.select("qid", "mode", *[F.col(c).cast("long").alias(c) for c in counts])


def graph_search_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).relationships.select("qid", "path", F.col("position").cast("long").alias("position"))


def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.analyse(text_plans._questions(spark, sf_dir)).select("qid", "question_type")


def planner_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = text_plans._questions(spark, sf_dir)
    given = q.where("qid % 3 = 0").select("qid", F.lit("a").alias("slot"), F.left("query", F.lit(10)).alias("question"), F.lit("exact_fact").alias("slot_type"))
    return search.plan(q, given)


def context_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.view(spark, sf_dir, fx.ASKED, "region").select("qid", F.initcap(F.replace("ckey", F.lit(":"), F.lit(" "))).alias("phrase"))
    members = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer").select(F.col("ckey").alias("key"), cx.key_display(F.col("ckey")).alias("display"), "vid")
    rows, _ = search.resolve_contexts(asked, members)
    return rows.select("qid", "key", "display", "level", "n_events", F.col("root_rank").cast("long").alias("root_rank"))


# -- the loop with its tools -------------------------------------------------------
def _loop(spark, sf_dir):
    """Each region asks for its contexts; region n starts at the n-th tool of the list."""
    asked = fx.view(spark, sf_dir, fx.ASKED, "region")
    lists = asked.groupBy("qid").agg(F.sort_array(F.collect_list("ckey")).alias("phrases"))
    names = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("qid"), "r_name")
    first = _table(spark, sf_dir, "customer").where("c_custkey < 5").select(F.col("c_custkey").cast("int").alias("qid"), F.array("c_name").alias("mentions"))
    q = lists.join(names, "qid").join(first, "qid").select("qid", F.concat(F.lit("the of and "), F.lower("r_name")).alias("query"), F.lit("collection_aggregation").alias("question_type"), "mentions", "phrases")
    q = shared_copy(q, "questions")
    people = _table(spark, sf_dir, "customer")
    index = people.select(F.col("c_custkey").alias("idx"), F.lit("Person").alias("vtype"), F.col("c_custkey").cast("string").alias("vid"), F.col("c_name").alias("name"))
    members = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer").select(F.col("ckey").alias("key"), cx.key_display(F.col("ckey")).alias("display"), "vid")
    docs = _table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_0")).alias("chunk_id"), F.col("source").alias("doc_id"), "text", F.col("lang").alias("title"), F.lit("").alias("url"))
    corpus = search.Corpus(index, members, shared_copy(graph_plans._edges(spark, sf_dir), "edges"), chunks)
    roots, _ = search.resolve_contexts(q.select("qid", F.explode("phrases").alias("phrase")), members)
    candidates = roots.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("root_rank", "key"))), lambda x: x["key"]).alias("candidates"))

    def propose(state):
        order = F.array(*[F.lit(a) for a in (*investigate.CAPS, "STOP")])
        proposal = F.get(order, ((F.col("step") + F.col("qid")) % 5).cast("int"))
        return state.withColumn("proposal", proposal).withColumn("reason", F.lit("all_slots_supported")).withColumn("target", F.lit(None).cast("string"))

    return investigate.run(candidates, propose, search.tools(q, corpus), shared_copy)


def agent_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = _loop(spark, sf_dir)
    counts = ("step", "graph_calls", "scope_calls", "vector_calls", "community_calls")
    return state.select(F.col("qid").cast("long").alias("qid"), *[F.col(c).cast("long").alias(c) for c in counts], "action", "reason_code")


def agent_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tools found, as the answer's context. No SQL: it is the loop's whole run."""
    _, evidence = _loop(spark, sf_dir)
    rows = evidence.withColumn("ord", F.struct("step", "source", "chunk_id"))
    return investigate.build_context(rows, investigate.COLLECTION_TOP_N).select("qid", "chunk_id", "source", F.col("support").cast("long").alias("support"), F.col("position").cast("long").alias("position"))


# -- loading -------------------------------------------------------------------------
def referenced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = graph_plans._chunk_texts(spark, sf_dir).select("chunk_id", tx.doc_of_chunk(F.col("chunk_id")).alias("doc_id"))
    return load.referenced_chunks(texts, graph_plans._edges(spark, sf_dir))


def context_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as events; those with an odd id have no context yet and stay as they are."""
    t = fx.view(spark, sf_dir, fx.TITLED, "documents").select("doc_id", "title")
    events = t.select(F.col("doc_id").alias("vid"), F.lit("old").alias("context_level"))
    contexts = cx.with_context(t.where("doc_id % 2 = 0"), "title", cx.sports(t)).select(F.col("doc_id").alias("vid"), "context")
    rows = load.backfill(events, contexts)
    return rows.select("vid", "context_level", "root_context", F.array_join("context_keys", "|").alias("context_keys"))


def pilot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_list(F.col("o_orderkey") % 5000).alias("gold_doc_ids"))
    return ingest.pilot(q, _table(spark, sf_dir, "labels")).select("qid")


# -- evaluation and prompts ------------------------------------------------------------
def _trace(spark, sf_dir):
    tool = F.get(F.array(*[F.lit(a) for a in investigate.ACTIONS]), (F.col("event_id") % 6).cast("int"))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("step"), tool.alias("tool"), F.col("event_type").alias("subquery"), F.round("value", 2).cast("decimal(18,2)").alias("ms"), (F.col("event_id") % 100).alias("tokens"))


def time_per_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.time_per_tool(_trace(spark, sf_dir))


def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agent_summary(investigate.assemble(_trace(spark, sf_dir)))


def llm_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trace(spark, sf_dir).select(F.col("subquery").alias("stage"), (F.col("step") % 1000).alias("input_tokens"), F.col("tokens").alias("output_tokens"), "ms")
    return evaluation.llm_totals(rows, "stage")


def question_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "events").select(F.col("event_id").alias("rid"), F.col("user_id").alias("qid"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("qtype"))
    asked = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("qid"), F.col("c_mktsegment").alias("qtype"))
    return evaluation.question_types(records, asked).select("rid", "qtype")


def _context(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("position"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "text", (F.col("turn") / 16).alias("rerank_score"), F.col("turn").alias("support"), F.when(F.col("role") == "user", "graph").otherwise("dense").alias("source"))


def answer_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.answer(_context(spark, sf_dir))
    return out.withColumn("citations", F.array_join("citations", "|"))


def slot_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _context(spark, sf_dir)
    slots = c.where("position = 1").select("qid", F.lit("s1").alias("slot"), F.left("text", F.lit(60)).alias("question"))
    return search.judge_slots(slots, c.where("position > 1"))


def history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.history_lines(_trace(spark, sf_dir).withColumn("result", F.col("tokens").cast("string")))


def prompt_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.chunk_lines(_context(spark, sf_dir))


def prompt_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = graph_plans._members(spark, sf_dir)
    seen = fx.view(spark, sf_dir, fx.ASKED, "region").where("ckey LIKE 'sport:%'").select("qid", F.col("ckey").alias("key"))
    return prompts.context_lines(graph.roots(members), seen)


def budget_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.budget_line(eval_plans._state(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        match_entities, match_contexts, entity_index_build, graph_search, graph_search_info, graph_search_paths, query_analysis, planner_fallback, context_resolver, agent_loop, agent_evidence,
        referenced_chunks, context_backfill, pilot_filter, time_per_tool, agent_summary, llm_totals, question_types, answer_extract, slot_judge, history_window, prompt_chunks, prompt_contexts, budget_line,
    )
}

_NAME = sql.name
_SIM = f"CASE WHEN {text_plans._SIZE.format(v='a.v')} * {text_plans._SIZE.format(v='b.v')} = 0 THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i]))::DOUBLE / ({text_plans._SIZE.format(v='a.v')} * {text_plans._SIZE.format(v='b.v')}) END"
_WORDS = "list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_SHARE = "len(list_intersect({q}, {c}))::DOUBLE / greatest(len({c}), 1)"
_EVENTS = "['GRAPH_SEARCH', 'GRAPH_SCOPE', 'VECTOR_SEARCH', 'COMMUNITY_SEARCH', 'REFORMULATE', 'STOP'][(event_id % 6) + 1]"
_DISPLAY = "replace(split_part({k}, ':', 2), '_', ' ')"

_ASKING = """SELECT c_custkey AS qid, unnest(['sport:building', 'olympics:1996']) AS ckey FROM customer WHERE c_custkey % 100 = 0 AND (c_custkey // 100) % 3 <> 1"""
_SEARCH = f"""{graph_plans._ROOTS_OF.format(keys=fx.duck(fx.KEYS), asked=_ASKING)}, {graph_plans._LOCAL},
wide AS (SELECT DISTINCT qid FROM roots WHERE qid % 200 = 0), ev AS (SELECT * FROM cand WHERE qid IN (SELECT qid FROM wide)),
pr AS (SELECT * FROM (SELECT qid, eid, event_ord, to_id AS chunk_id, row_number() OVER (PARTITION BY qid, eid ORDER BY {graph_plans._ORD.replace('chunk_id', 'to_id')}) AS k FROM ev JOIN e ON etype = 'MENTIONED_IN' AND from_type = 'ActionEvent' AND from_id = eid) WHERE k <= 2),
fr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, chunk_id ORDER BY event_ord, k) = 1 THEN 1 ELSE 0 END AS fresh FROM pr),
kept AS (SELECT * FROM (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY qid ORDER BY event_ord, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fr) WHERE before < 90),
parts AS (SELECT qid, chunk_id, count(DISTINCT eid) AS s, list(DISTINCT eid) AS evs, 1 AS scoped FROM kept GROUP BY 1, 2 UNION ALL SELECT qid, chunk_id, count(*), coalesce(list(DISTINCT eid) FILTER (eid IS NOT NULL), []), 0 FROM hit GROUP BY 1, 2),
found AS (SELECT qid, chunk_id, sum(s)::BIGINT AS support, max(scoped) AS scoped, list_min(flatten(list(evs))) AS tag FROM parts GROUP BY 1, 2),
nroots AS (SELECT qid, count(*) AS n_roots FROM roots GROUP BY 1),
q AS (SELECT c_custkey AS qid, c_custkey % 200 = 0 AS coll, coalesce(n_roots, 0) AS n_roots, c_custkey % 200 = 0 AND n_roots > 0 AS far, CASE WHEN c_custkey % 200 = 0 THEN 16 ELSE 5 END AS top_n FROM customer LEFT JOIN nroots ON qid = c_custkey WHERE c_custkey % 100 = 0),
tx AS (SELECT concat(doc_id, '_chunk_', i) AS chunk_id, len(list_intersect(['the', 'of', 'and', 'is'], {sql.tokens('text')})) AS nboth FROM documents, (SELECT unnest(range(7)) AS i)),
x AS (SELECT *, 1 / (1 + exp(-(8.0::DOUBLE * nboth / 4 - 4))) AS s, row_number() OVER (PARTITION BY qid ORDER BY support DESC, chunk_id) AS pos FROM found JOIN tx USING (chunk_id) JOIN q USING (qid)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS rerank, round(0.6::DOUBLE * s + 0.25::DOUBLE * (least(support, 5) / 5.0::DOUBLE) + 0.15::DOUBLE * scoped, 4) AS fs FROM x),
z AS (SELECT *, CASE WHEN tag IS NULL THEN false ELSE row_number() OVER (PARTITION BY qid, tag ORDER BY fs DESC, rerank) > CASE WHEN far THEN 2 ELSE 3 END END AS sunk FROM y),
n AS (SELECT qid, count(*) AS graph_chunks FROM z GROUP BY 1),
nfo AS (SELECT q.*, coalesce(graph_chunks, 0) AS graph_chunks, CASE WHEN far THEN CASE WHEN coalesce(graph_chunks, 0) < 3 THEN 3 ELSE 0 END ELSE greatest(0, top_n - coalesce(graph_chunks, 0)) END AS want FROM q LEFT JOIN n USING (qid)),
dn AS (SELECT qid, concat((qid + k) % (SELECT count(*) FROM documents), '_chunk_0') AS chunk_id, k + 1 AS rank FROM nfo, (SELECT unnest(range(10)) AS k)),
mo AS (SELECT * FROM (SELECT qid, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY 1 / (1 + exp(-(8.0::DOUBLE * nboth / 4 - 4))) DESC, rank) AS rerank, want FROM dn JOIN tx USING (chunk_id) JOIN nfo USING (qid) WHERE want > 0 AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM z)) WHERE rerank <= want),
al AS (SELECT qid, chunk_id, 'graph' AS source, sunk, rerank, 0 AS topup, pos, top_n FROM z UNION ALL SELECT qid, chunk_id, 'dense', false, rerank, 1, rank, top_n FROM mo JOIN q USING (qid)),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sunk, rerank, topup, pos) AS position FROM al) WHERE position <= top_n)"""

SQL = {
    "match_entities": f"""WITH ix AS (SELECT p_partkey AS idx, {_NAME('p_name')} AS norm FROM part),
mq AS (SELECT p_partkey AS qid, {_NAME("CASE (p_partkey // 50) % 4 WHEN 0 THEN concat('The ', p_name) WHEN 1 THEN concat(p_name, ' ', split_part(p_name, ' ', 1)) WHEN 2 THEN concat(p_name, ' " + LONG_TAIL + "') ELSE concat(repeat(concat(p_name, ' '), 12), '" + LONG_TAIL + "') END")} AS norm FROM part WHERE p_partkey % 50 = 0),
ex AS (SELECT qid, max(idx) AS idx FROM mq JOIN ix USING (norm) GROUP BY 1), {text_plans._vectors_sql('iv', 'ix', 'idx', 'norm')}, {text_plans._vectors_sql('mv', 'mq', 'qid', 'norm')},
s AS (SELECT qid, idx, {_SIM} AS sim FROM mv a, iv b WHERE qid NOT IN (SELECT qid FROM ex)), t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, idx) AS k FROM s),
w AS (SELECT t.*, {_WORDS.format(x='mq.norm')} AS q, {_WORDS.format(x='ix.norm')} AS c FROM t JOIN mq USING (qid) JOIN ix USING (idx) WHERE k <= 25), h AS (SELECT *, {_SHARE.format(q='q', c='c')} AS share FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 0.7::DOUBLE * sim + 0.3::DOUBLE * share DESC, idx DESC) AS n FROM h WHERE CASE WHEN len(q) > 12 THEN share >= 0.999 AND sim >= 0.85 ELSE sim >= 0.9 OR (share >= 0.6 AND sim >= 0.8) END)
SELECT qid, CAST(idx AS VARCHAR) AS vid, 'exact' AS how FROM ex UNION ALL SELECT qid, CAST(idx AS VARCHAR), 'fuzzy' FROM g WHERE n = 1 UNION ALL SELECT qid, NULL, 'none' FROM mq WHERE qid NOT IN (SELECT qid FROM ex) AND qid NOT IN (SELECT qid FROM g)""",
    "match_contexts": f"""WITH kx AS (SELECT DISTINCT ckey AS key FROM ({fx.duck(fx.KEYS)})), ix AS (SELECT key, {_DISPLAY.format(k='key')} AS display, {_NAME(_DISPLAY.format(k='key'))} AS norm FROM kx),
a0 AS (SELECT qid, ckey, CASE WHEN qid % 2 = 0 THEN ckey ELSE concat({_DISPLAY.format(k='ckey')}, ' and ', {_DISPLAY.format(k='ckey')}, ' and games') END AS phrase FROM ({fx.duck(fx.ASKED)})),
mq AS (SELECT DISTINCT phrase, {_NAME('phrase')} AS norm FROM a0), {text_plans._vectors_sql('iv', 'ix', 'key', 'norm')}, {text_plans._vectors_sql('mv', 'mq', 'phrase', 'norm')},
s AS (SELECT phrase, key, {_SIM} AS sim FROM mv a, iv b), t AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY sim DESC, key) AS k FROM s),
w AS (SELECT t.*, display, {_SHARE.format(q=_WORDS.format(x='mq.norm'), c=_WORDS.format(x='ix.norm'))} AS share FROM t JOIN mq USING (phrase) JOIN ix USING (key) WHERE k <= 5),
g AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY 0.7::DOUBLE * sim + 0.3::DOUBLE * share DESC, key DESC) AS n FROM w WHERE sim >= 0.9 OR (share >= 0.6 AND sim >= 0.8) OR sim >= 0.85)
SELECT qid, phrase, key, display, 'exact' AS how FROM a0 JOIN ix ON key = phrase UNION ALL SELECT qid, phrase, key, display, 'fuzzy' FROM a0 JOIN g USING (phrase) WHERE n = 1 AND phrase NOT IN (SELECT key FROM ix)""",
    "entity_index_build": f"SELECT row_number() OVER (ORDER BY p_type, CAST(p_partkey AS VARCHAR)) - 1 AS idx, p_type AS vtype, CAST(p_partkey AS VARCHAR) AS vid, {_NAME(chr(39) + 'The ' + chr(39) + ' || p_name')} AS norm FROM part",
    "graph_search": f"WITH {_SEARCH} SELECT qid, chunk_id, source, position FROM final",
    "graph_search_info": f"""WITH {_SEARCH} SELECT nfo.qid, CASE WHEN far THEN 'scope' ELSE 'local' END AS mode, 1::BIGINT AS n_seeds, n_roots, (SELECT count(*) FROM ev WHERE ev.qid = nfo.qid) AS scope_events, graph_chunks,
  (SELECT count(*) FROM found WHERE found.qid = nfo.qid AND chunk_id NOT IN (SELECT chunk_id FROM tx)) AS missing_chunks, (SELECT count(*) FROM final WHERE final.qid = nfo.qid AND source = 'dense') AS dense_topup, (SELECT count(*) FROM final WHERE final.qid = nfo.qid) AS final_chunks FROM nfo""",
    "graph_search_paths": f"""WITH {_SEARCH}, p AS (SELECT qid, from_id AS eid, concat('ActionEvent:', from_id, ' -', etype, '-> ', to_type, ':', to_id) AS path FROM seeds JOIN e ON etype <> 'MENTIONED_IN' AND to_type = vtype AND to_id = vid WHERE qid NOT IN (SELECT qid FROM wide)),
e5 AS (SELECT * FROM (SELECT qid, eid, row_number() OVER (PARTITION BY qid ORDER BY eid) AS k FROM (SELECT DISTINCT qid, eid FROM p)) WHERE k <= 5 UNION ALL SELECT qid, eid, event_ord FROM ev WHERE event_ord <= 10),
a AS (SELECT qid, path FROM p UNION SELECT qid, concat('ActionEvent:', from_id, ' -', etype, '-> ', to_type, ':', to_id) FROM e5 JOIN e ON from_type = 'ActionEvent' AND from_id = eid AND etype <> 'MENTIONED_IN')
SELECT * FROM (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY path) AS position FROM a) WHERE position <= 20""",
    "query_analysis": f"SELECT item_id AS qid, CASE WHEN regexp_matches(text, {sql.quote(search.COLLECTION_WORDS)}) THEN 'collection_aggregation' ELSE 'local_fact' END AS question_type FROM benchmark",
    "planner_fallback": "SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE 's1' END AS slot, CASE WHEN item_id % 3 = 0 THEN left(text, 10) ELSE text END AS question, CASE WHEN item_id % 3 = 0 THEN 'exact_fact' ELSE 'relational' END AS slot_type FROM benchmark",
    "context_resolver": f"WITH {graph_plans._ROOTS} SELECT qid, key, {_DISPLAY.format(k='key')} AS display, CASE specificity WHEN 4 THEN 'event' WHEN 3 THEN 'sport' ELSE 'edition' END AS level, n_events, root_rank FROM roots",
    "agent_loop": "SELECT r_regionkey::BIGINT AS qid, (5 - r_regionkey)::BIGINT AS step, (r_regionkey <= 0)::BIGINT AS graph_calls, (r_regionkey <= 1)::BIGINT AS scope_calls, (r_regionkey <= 2)::BIGINT AS vector_calls, (r_regionkey <= 3)::BIGINT AS community_calls, 'STOP' AS action, 'sufficient_evidence' AS reason_code FROM region",
    "referenced_chunks": f"WITH e AS ({fx.duck(fx.EDGES)}) SELECT concat(doc_id, '_chunk_', i) AS chunk_id, CAST(doc_id AS VARCHAR) AS doc_id FROM documents, (SELECT unnest(range(7)) AS i) WHERE concat(doc_id, '_chunk_', i) IN (SELECT to_id FROM e WHERE etype = 'MENTIONED_IN')",
    "context_backfill": f"""WITH c AS ({text_plans.SQL['derive_context']}) SELECT doc_id AS vid, CASE WHEN doc_id % 2 = 0 THEN context_level ELSE 'old' END AS context_level, CASE WHEN doc_id % 2 = 0 THEN root_context END AS root_context, CASE WHEN doc_id % 2 = 0 THEN context_keys END AS context_keys FROM c""",
    "pilot_filter": "SELECT DISTINCT o_custkey AS qid FROM orders WHERE o_orderkey % 5000 IN (SELECT doc_id FROM labels)",
    "time_per_tool": f"SELECT user_id AS qid, {_EVENTS} AS tool, count(*) AS calls, sum(round(value, 2)::DECIMAL(18, 2))::DOUBLE AS ms, round(sum(event_id % 100) / count(*), 2) AS tokens_per_op FROM events GROUP BY 1, 2",
    "agent_summary": f"""WITH r AS (SELECT user_id, count(*) AS steps, count(DISTINCT {_EVENTS}) FILTER (event_id % 6 < 4) > 1 AS changed, sum(event_id % 100) AS tokens FROM events GROUP BY 1)
SELECT count(*) AS n, round(avg(steps), 2) AS avg_steps, round(avg(changed::INT), 4) AS strategy_change_rate, round(sum(tokens) / sum(steps), 2) AS tokens_per_op FROM r""",
    "llm_totals": "SELECT event_type AS stage, count(*) AS calls, sum(event_id % 1000)::BIGINT AS input_tokens, sum(event_id % 100)::BIGINT AS output_tokens, sum(event_id % 1000 + event_id % 100)::BIGINT AS total_tokens, round(sum(round(value, 2)::DECIMAL(18, 2)), 2)::DOUBLE AS latency_total_ms FROM events GROUP BY 1",
    "question_types": "SELECT event_id AS rid, coalesce(c_mktsegment, CASE WHEN event_id % 3 = 0 THEN event_type END, 'unknown') AS qtype FROM events LEFT JOIN customer ON c_custkey = user_id AND c_custkey % 2 = 0",
    "answer_extract": f"""SELECT conv_id AS qid, {sql.strip('left(arg_min(text, turn), 300)')} AS predicted, coalesce(string_agg(concat(conv_id, '_', turn), '|' ORDER BY turn) FILTER (turn < 3), '') AS citations, count(*) >= 3 AS evidence_sufficient, max(turn / 16) AS confidence FROM conversations GROUP BY 1""",
    "slot_judge": f"""WITH s AS (SELECT conv_id, left(text, 60) AS question FROM conversations WHERE turn = 0), p AS (SELECT s.conv_id, list_distinct({sql.tokens('question')}) AS c, list_distinct({sql.tokens("coalesce(text, '')")}) AS q FROM s LEFT JOIN conversations v ON v.conv_id = s.conv_id AND v.turn > 0),
b AS (SELECT conv_id, round(max(len(list_intersect(q, c))::DOUBLE / greatest(len(c), 1)), 4) AS score FROM p GROUP BY 1)
SELECT conv_id AS qid, 's1' AS slot, score AS support_score, CASE WHEN score >= 0.6 THEN 'supported' WHEN score >= 0.3 THEN 'partial' ELSE 'missing' END AS status FROM b""",
    "history_window": f"""WITH t AS (SELECT user_id AS qid, event_id AS step, {_EVENTS} AS tool, event_type AS q, event_id % 100 AS r, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
SELECT qid, string_agg(concat('  step ', step, ': ', tool, ' query=', left(q, 60), ' -> ', r), chr(10) ORDER BY step) AS history FROM t WHERE n <= 6 GROUP BY 1""",
    "prompt_chunks": "WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id AS qid, string_agg(concat('  [', conv_id, '_', turn, '] (', CASE WHEN role = 'user' THEN 'graph' ELSE 'dense' END, ', support=', turn, ') ', replace(left(coalesce(text, ''), 600), chr(10), ' ')), chr(10) ORDER BY turn) AS chunks FROM c WHERE n <= 14 GROUP BY 1",
    "prompt_contexts": f"WITH {graph_plans._ROOTS} SELECT qid, string_agg(concat('  ', key, ' [', CASE specificity WHEN 4 THEN 'event' WHEN 3 THEN 'sport' ELSE 'edition' END, '] ~', n_events, ' events', CASE WHEN starts_with(key, 'sport:') THEN ' (investigated)' ELSE '' END), chr(10) ORDER BY root_rank) AS contexts FROM roots GROUP BY 1",
    "budget_line": "SELECT o_orderkey AS qid, concat('steps ', o_orderkey % 7, '/5, graph calls ', o_orderkey % 5, '/3, scope calls ', o_orderkey % 4, '/2, vector calls ', o_orderkey % 3, '/2, community calls ', o_orderkey % 2, '/1') AS budget FROM orders",
}
