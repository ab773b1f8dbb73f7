"""Queries over resolution, matching, traversal and ranking, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx
from lodestone.operators import graph, matching, ranking, resolve

from . import fixtures as fx
from . import sql, text_plans


def _records(spark, sf_dir):
    """One record per chunk: its items as entities and as events."""
    items = fx.view(spark, sf_dir, fx.ITEMS, "lineitem", "documents")
    entity = F.struct("name", F.col("vtype").alias("type"), "description")
    targets = F.array("name", F.lit("nobody"))
    event = F.struct(F.concat(F.lit("Deal "), (F.col("ord") % 1000).cast("string")).alias("name"), F.col("l_returnflag").alias("action_type"), "description", F.lit("").alias("impact_summary"), targets.alias("initiated_by"), F.array("name").alias("took_place_at"), F.array().cast("array<string>").alias("affected"), F.array().cast("array<string>").alias("resulted_in"))
    rows = items.select("chunk_id", F.struct("ord", "item").alias("chunk_ord"), F.array(entity).alias("entities"), F.array(event).alias("action_events"))
    return rows.withColumn("doc_id", tx.doc_of_chunk(F.col("chunk_id")))


def ontology_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.validate(_records(spark, sf_dir))
    return rows.groupBy("chunk_id").agg(*[F.sum(c).alias(c) for c in ("n_entities", "n_events", "n_relations", "dropped")])


def _entities(spark, sf_dir):
    return resolve.entities(_records(spark, sf_dir))


def entity_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.entity_merge(_entities(spark, sf_dir))
    return rows.select("vtype", "vid", "name", "description", F.array_join("mentioned_in", "|").alias("mentioned_in"))


def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.alias_map(_entities(spark, sf_dir))


def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve.event_merge(resolve.raw_events(_records(spark, sf_dir)))
    return rows.select("vid", "name", "action_type", "description", F.array_join("mentioned_in", "|").alias("mentioned_in"))


def edges_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(_records(spark, sf_dir)).edges


def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)
    return e.groupBy("from_type").agg(F.count_if(F.col("etype") != "MENTIONED_IN").alias("relations"), F.count_if(F.col("etype") == "MENTIONED_IN").alias("groundings"))


def merge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each title's context, its gaps filled from the one before it."""
    t = fx.view(spark, sf_dir, fx.TITLED, "documents").select("doc_id", "title")
    c = cx.with_context(t, "title", cx.sports(t), "c").select("doc_id", "c")
    pairs = c.join(c.select((F.col("doc_id") + 1).alias("doc_id"), F.col("c").alias("t")), "doc_id", "left")
    m = pairs.select("doc_id", cx.merge_contexts(F.col("c"), F.col("t")).alias("m"))
    return m.select("doc_id", F.col("m.root_context").alias("root_context"), F.array_join("m.context_path", "|").alias("path"), F.array_join("m.context_keys", "|").alias("context_keys"), F.col("m.context_level").alias("context_level"))


def context_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as events."""
    t = fx.view(spark, sf_dir, fx.TITLED, "documents").select("doc_id", "title")
    events = cx.with_context(t, "title", cx.sports(t)).select(F.col("doc_id").cast("string").alias("vid"), "context")
    rows = resolve.context_index(events)
    return rows.select("key", "display", F.size("vertex_ids").cast("long").alias("n"), F.array_join("vertex_ids", "|").alias("vertex_ids"))


def context_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer").select(F.col("ckey").alias("key")).distinct()
    index = keys.select("key", cx.key_display(F.col("key")).alias("display"), F.array(F.lit("v")).alias("vertex_ids"))
    asked = fx.view(spark, sf_dir, fx.ASKED, "region").select("qid", F.when(F.col("qid") % 2 == 0, F.initcap(F.replace("ckey", F.lit(":"), F.lit(" ")))).otherwise(F.col("ckey")).alias("phrase"))
    return matching.exact_keys(asked, index).select("qid", "phrase", "key", "display")


def match_entities_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    index = parts.select(F.col("p_partkey").alias("idx"), F.col("p_type").alias("vtype"), F.col("p_partkey").cast("string").alias("vid"), F.concat(F.lit("The "), "p_name").alias("name"))
    mentions = parts.select(F.col("p_partkey").alias("qid"), F.lit(0).alias("mention_ord"), F.col("p_name").alias("mention"))
    return matching.exact_entities(mentions, index).select("qid", "vtype", "vid", "name")


def match_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose id is divisible by 100 as mentions, all vectors as the index,
    the names made of the cluster's label and the id's last digit."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    name = F.concat(F.lit("cluster "), F.col("label").cast("string"), F.lit(" item "), (F.col("vec_id") % 10).cast("string"))
    index = e.select(F.col("vec_id").alias("idx"), F.lit("Entity").alias("vtype"), F.col("vec_id").cast("string").alias("vid"), name.alias("name"), "embedding")
    mentions = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.lit(0).alias("mention_ord"), F.concat(name, F.lit(" extra")).alias("mention"), F.col("embedding").alias("vec"))
    rows = matching.fuzzy_entities(mentions, index)
    return rows.select(F.col("qid").cast("long").alias("qid"), "vid", F.round("score", 6).alias("score"))


def _members(spark, sf_dir):
    """A row for each event of the keys that the regions ask for."""
    keys = fx.view(spark, sf_dir, fx.KEYS, "orders", "customer")
    return fx.view(spark, sf_dir, fx.ASKED, "region").join(keys, "ckey").select("qid", F.col("ckey").alias("key"), F.col("ckey").alias("display"), "vid")


def scope_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.roots(_members(spark, sf_dir))
    return rows.select("qid", "key", "level", F.col("specificity").cast("long").alias("specificity"), "n_events", F.col("root_rank").cast("long").alias("root_rank"))


def _edges(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.EDGES, "orders", "customer", "nation", "lineitem", "documents")


def _seeds(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.SEEDS, "customer")


def _flat(rows):
    lists = [F.array_join(c, "|").alias(c) for c in ("via", "event_ids", "context_keys") if c in rows.columns]
    return rows.select("qid", "chunk_id", F.col("support").cast("long").alias("support"), *lists)


def traverse_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(graph.traverse_local(_seeds(spark, sf_dir), _edges(spark, sf_dir)))


def traverse_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(graph.traverse_local(_seeds(spark, sf_dir), _edges(spark, sf_dir), distinct_events=True))


def _scope(spark, sf_dir):
    members = _members(spark, sf_dir)
    return graph.traverse_scope(graph.candidate_events(graph.roots(members), members), _edges(spark, sf_dir))


def candidate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _members(spark, sf_dir)
    rows = graph.candidate_events(graph.roots(members), members)
    return rows.select("qid", "eid", F.col("event_ord").cast("long").alias("event_ord"), F.array_join("keys", "|").alias("context_keys"))


def traverse_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_scope(spark, sf_dir))


def merge_traversals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope and local maps of the same questions, customers standing for regions."""
    local = graph.traverse_local(_seeds(spark, sf_dir), _edges(spark, sf_dir)).withColumn("qid", F.floor(F.col("qid") / 100) % 5)
    local = local.groupBy("qid", "chunk_id").agg(F.sum("support").alias("support"), F.array_distinct(F.flatten(F.collect_list("via"))).alias("via"), F.array_distinct(F.flatten(F.collect_list("event_ids"))).alias("event_ids"))
    return _flat(graph.merge_traversals(_scope(spark, sf_dir).withColumn("qid", F.col("qid").cast("long")), local))


def relationship_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.relationship_paths(_seeds(spark, sf_dir), _edges(spark, sf_dir))
    return rows.select("qid", "path", F.col("position").cast("long").alias("position"))


def _asked(spark, sf_dir):
    q = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 100 = 0")
    kind = F.when(F.col("c_custkey") % 200 == 0, ranking.COLLECTION).otherwise("local")
    return q.select(F.col("c_custkey").alias("qid"), F.lit("the of and is").alias("query"), kind.alias("question_type"), F.array(F.lit("sport:building")).alias("requested_keys"))


def _chunk_texts(spark, sf_dir):
    """Documents as the chunks that the graph's edges name."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat_ws("_chunk_", F.col("doc_id").cast("string"), i.cast("string")))).alias("chunk_id"), "text")


def _found(spark, sf_dir):
    return graph.traverse_local(_seeds(spark, sf_dir), _edges(spark, sf_dir)).withColumn("context_keys", F.array(F.concat(F.lit("Sport "), F.when(F.col("support") > 1, "building").otherwise("none"))))


def rank_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.score(_found(spark, sf_dir), _chunk_texts(spark, sf_dir), _asked(spark, sf_dir))
    return rows.select("qid", "chunk_id", F.col("rerank").cast("long").alias("rerank"), F.round("final_score", 3).alias("final_score"), "sunk")


def coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranking.score(_found(spark, sf_dir), _chunk_texts(spark, sf_dir), _asked(spark, sf_dir))
    return ranking.info(scored, _asked(spark, sf_dir)).select("qid", "graph_chunks", "distinct_events", "scope_coverage", "want", "gate")


def rank_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With dense hits that take chunk 0 of the documents from the question's id on."""
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count("*").alias("n"))
    dense = _asked(spark, sf_dir).select("qid", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).join(F.broadcast(n)).select("qid", F.concat(((F.col("qid") + F.col("k")) % F.col("n")).cast("string"), F.lit("_chunk_0")).alias("chunk_id"), (F.col("k") + 1).cast("int").alias("rank"))
    rows = ranking.rank_chunks(_found(spark, sf_dir), _chunk_texts(spark, sf_dir), _asked(spark, sf_dir), dense)
    return rows.select("qid", "chunk_id", "source", F.col("position").cast("long").alias("position"))


QUERIES = {f.__name__: f for f in (ontology_validate, entity_merge, alias_map, event_merge, edges_build, graph_counts, merge_context, context_index, context_match_exact, match_entities_exact, match_fuzzy, scope_resolve, candidate_events, traverse_local, traverse_distinct, traverse_scope, merge_traversals, relationship_paths, rank_composite, coverage_verdict, rank_final)}

_ITEMS = f"items AS ({fx.duck(fx.ITEMS)})"
_ENTS = f"{_ITEMS}, ents AS (SELECT *, {sql.name('name')} AS vid FROM items WHERE vtype <> 'Gadget')"
_EVS = f"evs AS (SELECT *, concat('deal ', ord % 1000) AS vid, concat('Deal ', ord % 1000) AS ename FROM items)"
_ALIAS = "al AS (SELECT name, arg_min(vtype, (ord, item)) AS vtype, arg_min(vid, (ord, item)) AS vid FROM ents GROUP BY 1)"
_EDGES = f"e AS ({fx.duck(fx.EDGES)}), seeds AS ({fx.duck(fx.SEEDS)})"
_ORD = "regexp_extract(chunk_id, '^(.*)_chunk_', 1), regexp_extract(chunk_id, '_chunk_([0-9]+)$', 1)::INT"
_LOCAL = f"""{_EDGES},
men AS (SELECT from_type AS vtype, from_id AS vid, to_id AS chunk_id FROM e WHERE etype = 'MENTIONED_IN'),
direct AS (SELECT * FROM (SELECT qid, vtype, vid, chunk_id, row_number() OVER (PARTITION BY qid, vtype, vid ORDER BY {_ORD}) AS k FROM seeds JOIN men USING (vtype, vid)) WHERE k <= 25),
near AS (SELECT DISTINCT qid, s.vid, from_id AS eid FROM seeds s JOIN e ON etype <> 'MENTIONED_IN' AND to_type = vtype AND to_id = s.vid),
med AS (SELECT qid, near.vid, eid, chunk_id FROM near JOIN men ON men.vtype = 'ActionEvent' AND men.vid = eid),
hit AS (SELECT qid, chunk_id, vid, NULL AS eid FROM direct UNION ALL SELECT qid, chunk_id, vid, eid FROM med)"""
_VIA = "array_to_string(list_sort(list(DISTINCT CASE WHEN eid IS NULL THEN concat('direct:', vid) ELSE concat('event:', left(eid, 48)) END)), '|') AS via"
_ROOTS_OF = """k AS ({keys}), asked AS ({asked}),
m AS (SELECT qid, ckey AS key, vid FROM asked JOIN k USING (ckey)),
r0 AS (SELECT qid, key, list_sort(list(DISTINCT vid)) AS vids, count(DISTINCT vid) AS n_events, CASE split_part(key, ':', 1) WHEN 'event' THEN 4 WHEN 'sport' THEN 3 WHEN 'olympics' THEN 2 ELSE 1 END AS specificity FROM m GROUP BY 1, 2),
roots AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY specificity DESC, n_events DESC, key) AS root_rank FROM r0) WHERE root_rank <= 4),
cand0 AS (SELECT qid, root_rank, key, unnest(vids[1:40]) AS eid, unnest(range(1, least(40, len(vids)) + 1)) AS pos FROM roots),
cand AS (SELECT qid, eid, array_to_string(list(key ORDER BY root_rank), '|') AS context_keys, row_number() OVER (PARTITION BY qid ORDER BY min((root_rank, pos))) AS event_ord FROM cand0 GROUP BY 1, 2)"""
_ROOTS = _ROOTS_OF.format(keys=fx.duck(fx.KEYS), asked=fx.duck(fx.ASKED))
_SCOPE = f"""{_ROOTS}, {_EDGES}, pr AS (SELECT * FROM (SELECT qid, eid, event_ord, to_id AS chunk_id, row_number() OVER (PARTITION BY qid, eid ORDER BY {_ORD.replace('chunk_id', 'to_id')}) AS k FROM cand JOIN e ON etype = 'MENTIONED_IN' AND from_type = 'ActionEvent' AND from_id = eid) WHERE k <= 2),
fr AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY qid, chunk_id ORDER BY event_ord, k) = 1 THEN 1 ELSE 0 END AS fresh FROM pr),
kept AS (SELECT * FROM (SELECT *, coalesce(sum(fresh) OVER (PARTITION BY qid ORDER BY event_ord, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fr) WHERE before < 90)"""
_KEYS_OF = """keys_of AS (SELECT qid, chunk_id, string_agg(key, '|' ORDER BY o) AS context_keys FROM (SELECT kept.qid, chunk_id, key, min(event_ord * 100 + root_rank) AS o FROM kept JOIN cand0 USING (qid, eid) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_SCORED = f"""{_LOCAL}, found AS (SELECT qid, chunk_id, count(*) AS support, min(eid) AS tag FROM hit GROUP BY 1, 2),
tx AS (SELECT concat(doc_id, '_chunk_', i) AS chunk_id, len(list_intersect(['the', 'of', 'and', 'is'], {sql.tokens('text')})) AS nboth FROM documents, (SELECT unnest(range(7)) AS i)),
x AS (SELECT *, 1 / (1 + exp(-(8.0::DOUBLE * nboth / 4 - 4))) AS s, row_number() OVER (PARTITION BY qid ORDER BY support DESC, chunk_id) AS pos FROM found JOIN tx USING (chunk_id)),
y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, pos) AS rerank, round(0.6::DOUBLE * s + 0.25::DOUBLE * least(support, 5) / 5.0::DOUBLE + CASE WHEN support > 1 THEN 0.15::DOUBLE ELSE 0 END, 4) AS fs FROM x),
z AS (SELECT *, CASE WHEN tag IS NULL THEN false ELSE row_number() OVER (PARTITION BY qid, tag ORDER BY fs DESC, rerank) > CASE WHEN qid % 200 = 0 THEN 2 ELSE 3 END END AS sunk FROM y),
nfo0 AS (SELECT c_custkey AS qid, c_custkey % 200 = 0 AS wide, coalesce(n, 0) AS graph_chunks, coalesce(ev, 0) AS distinct_events FROM customer LEFT JOIN (SELECT qid, count(*) AS n, count(DISTINCT tag) AS ev FROM z GROUP BY 1) ON qid = c_custkey WHERE c_custkey % 100 = 0),
nfo AS (SELECT *, CASE WHEN wide THEN CASE WHEN distinct_events <= 0 THEN 'none' WHEN distinct_events >= 10 AND graph_chunks >= 15 THEN 'high' WHEN distinct_events >= 5 AND graph_chunks >= 8 THEN 'substantial' ELSE 'partial' END WHEN graph_chunks >= 3 THEN 'high' ELSE 'partial' END AS scope_coverage,
  CASE WHEN wide THEN CASE WHEN graph_chunks < 3 THEN 3 ELSE 0 END ELSE greatest(0, 5 - graph_chunks) END AS want FROM nfo0)"""

_N = sql.name
SQL = {
    "merge_context": f"""WITH c AS ({text_plans.SQL['derive_context']}), j AS (SELECT a.*, string_split(a.path, '|') AS ep, string_split(a.context_keys, '|') AS ek, b.root_context AS tr, string_split(b.path, '|') AS tp, string_split(b.context_keys, '|') AS tk, b.context_level AS tl FROM c a LEFT JOIN c b ON b.doc_id = a.doc_id - 1)
      SELECT doc_id, CASE WHEN tl IN ('sport', 'event') THEN tr ELSE root_context END AS root_context,
        CASE WHEN tl IS NULL THEN path ELSE array_to_string(list_concat(ep, list_filter(tp, lambda p: NOT list_contains(list_transform(ep, lambda q: {_N('q')}), {_N('p')}))), '|') END AS path,
        CASE WHEN tl IS NULL THEN context_keys ELSE array_to_string(list_concat(ek, list_filter(tk, lambda p: NOT list_contains(ek, p))), '|') END AS context_keys,
        CASE WHEN context_level = 'edition' AND tl <> 'edition' THEN 'sport' ELSE context_level END AS context_level FROM j""",
    "context_index": f"""WITH c AS ({text_plans.SQL['derive_context']}), r AS (SELECT CAST(doc_id AS VARCHAR) AS vid, root_context AS root, unnest(string_split(context_keys, '|')) AS k FROM c),
      s AS (SELECT *, CASE WHEN contains(lower(root), 'summer') THEN 'summer' WHEN contains(lower(root), 'winter') THEN 'winter' END AS season FROM r WHERE starts_with(k, 'olympics:')),
      b AS (SELECT k FROM s GROUP BY 1 HAVING count(DISTINCT season) > 1),
      u AS (SELECT k AS key, CASE WHEN starts_with(k, 'olympics:') THEN concat(split_part(k, ':', 2), ' olympics') ELSE replace(split_part(k, ':', 2), '_', ' ') END AS display, list_sort(list(DISTINCT vid)) AS v FROM r GROUP BY 1, 2
        UNION ALL SELECT concat(k, '_', season), lower(max(root)), list_sort(list(DISTINCT vid)) FROM s JOIN b USING (k) WHERE season IS NOT NULL GROUP BY k, season)
      SELECT key, display, len(v)::BIGINT AS n, array_to_string(v, '|') AS vertex_ids FROM u""",
    "ontology_validate": f"""WITH {_ITEMS} SELECT chunk_id, count_if(vtype <> 'Gadget')::BIGINT AS n_entities, count(*)::BIGINT AS n_events,
      count_if(vtype IN ('Person', 'Company', 'Venue'))::BIGINT AS n_relations, (count(*) * 4 - count_if(vtype <> 'Gadget') - count_if(vtype IN ('Person', 'Company', 'Venue')))::BIGINT AS dropped FROM items GROUP BY 1""",
    "entity_merge": f"""WITH {_ENTS}, n AS (SELECT vtype, vid, name, count(*) AS n, min((ord, item)) AS f FROM ents GROUP BY 1, 2, 3), nm AS (SELECT vtype, vid, arg_min(name, (-n, f)) AS name FROM n GROUP BY 1, 2)
      SELECT vtype, vid, nm.name, coalesce(arg_min(ents.description, (ord, item)) FILTER (ents.description <> ''), '') AS description, array_to_string(list_sort(list(DISTINCT chunk_id)), '|') AS mentioned_in FROM ents JOIN nm USING (vtype, vid) GROUP BY 1, 2, 3""",
    "alias_map": f"WITH {_ENTS}, {_ALIAS} SELECT name AS raw_name, vtype, vid FROM al",
    "event_merge": f"""WITH {_ITEMS}, {_EVS}, n AS (SELECT vid, l_returnflag, count(*) AS n, min((ord, item)) AS f FROM evs GROUP BY 1, 2), t AS (SELECT vid, arg_min(l_returnflag, (-n, f)) AS action_type FROM n GROUP BY 1)
      SELECT vid, any_value(ename) AS name, any_value(action_type) AS action_type, coalesce(arg_min(description, (ord, item)) FILTER (description <> ''), '') AS description, array_to_string(list_sort(list(DISTINCT chunk_id)), '|') AS mentioned_in FROM evs JOIN t USING (vid) GROUP BY 1""",
    "edges_build": f"""WITH {_ENTS}, {_EVS}, {_ALIAS}, r AS (SELECT DISTINCT evs.vid, al.vtype AS to_type, al.vid AS to_id FROM evs JOIN al ON al.name = evs.name)
      SELECT 'INITIATED_BY' AS etype, 'ActionEvent' AS from_type, vid AS from_id, to_type, to_id FROM r WHERE to_type IN ('Person', 'Company')
      UNION ALL SELECT 'TOOK_PLACE_AT', 'ActionEvent', vid, to_type, to_id FROM r WHERE to_type = 'Venue'
      UNION ALL SELECT DISTINCT 'MENTIONED_IN', 'ActionEvent', vid, 'Chunk', chunk_id FROM evs UNION ALL SELECT DISTINCT 'MENTIONED_IN', vtype, vid, 'Chunk', chunk_id FROM ents""",
    "graph_counts": f"WITH {_EDGES} SELECT from_type, count_if(etype <> 'MENTIONED_IN')::BIGINT AS relations, count_if(etype = 'MENTIONED_IN')::BIGINT AS groundings FROM e GROUP BY 1",
    "context_match_exact": f"""WITH k AS (SELECT DISTINCT ckey FROM ({fx.duck(fx.KEYS)})), a AS ({fx.duck(fx.ASKED)})
      SELECT qid, CASE WHEN qid % 2 = 0 THEN concat(upper(left(ckey, 1)), substr(split_part(ckey, ':', 1), 2), ' ', upper(left(split_part(ckey, ':', 2), 1)), substr(split_part(ckey, ':', 2), 2)) ELSE ckey END AS phrase, ckey AS key, replace(split_part(ckey, ':', 2), '_', ' ') AS display FROM a JOIN k USING (ckey)""",
    "match_entities_exact": f"""WITH b AS (SELECT {sql.name("concat('The ', p_name)")} AS norm, max(p_partkey) AS top FROM part GROUP BY 1)
      SELECT p.p_partkey AS qid, v.p_type AS vtype, CAST(top AS VARCHAR) AS vid, concat('The ', v.p_name) AS name FROM part p JOIN b ON {sql.name('p.p_name')} = norm JOIN part v ON v.p_partkey = top""",
    "scope_resolve": f"WITH {_ROOTS} SELECT qid, key, CASE specificity WHEN 4 THEN 'event' WHEN 3 THEN 'sport' ELSE 'edition' END AS level, specificity::BIGINT AS specificity, n_events, root_rank FROM roots",
    "candidate_events": f"WITH {_ROOTS} SELECT qid, eid, event_ord, context_keys FROM cand",
    "traverse_local": f"WITH {_LOCAL} SELECT qid, chunk_id, count(*) AS support, {_VIA}, coalesce(array_to_string(list_sort(list(DISTINCT eid) FILTER (eid IS NOT NULL)), '|'), '') AS event_ids FROM hit GROUP BY 1, 2",
    "traverse_distinct": f"WITH {_LOCAL} SELECT qid, chunk_id, count(DISTINCT eid) + count(DISTINCT CASE WHEN eid IS NULL THEN vid END) AS support, {_VIA}, coalesce(array_to_string(list_sort(list(DISTINCT eid) FILTER (eid IS NOT NULL)), '|'), '') AS event_ids FROM hit GROUP BY 1, 2",
    "traverse_scope": f"""WITH {_SCOPE}, {_KEYS_OF}, sc AS (SELECT qid, chunk_id, count(DISTINCT eid) AS support, array_to_string(list_sort(list(DISTINCT concat('scope:', left(eid, 48)))), '|') AS via, array_to_string(list_sort(list(DISTINCT eid)), '|') AS event_ids FROM kept GROUP BY 1, 2)
      SELECT sc.*, context_keys FROM sc JOIN keys_of USING (qid, chunk_id)""",
    "merge_traversals": f"""WITH {_LOCAL}, {_SCOPE.replace(_EDGES + ', ', '')}, b AS (SELECT qid::BIGINT AS qid, chunk_id, count(DISTINCT eid) AS s, list(DISTINCT eid) AS ev, list(DISTINCT concat('scope:', left(eid, 48))) AS vi FROM kept GROUP BY 1, 2
        UNION ALL SELECT (qid // 100) % 5, chunk_id, count(*), list(DISTINCT eid) FILTER (eid IS NOT NULL), list(DISTINCT CASE WHEN eid IS NULL THEN concat('direct:', vid) ELSE concat('event:', left(eid, 48)) END) FROM hit GROUP BY 1, 2),
      ky AS (SELECT qid::BIGINT AS qid, chunk_id, array_to_string(list_sort(list(DISTINCT key)), '|') AS context_keys FROM kept JOIN cand0 USING (qid, eid) GROUP BY 1, 2),
      u AS (SELECT qid, chunk_id, sum(s)::BIGINT AS support, coalesce(array_to_string(list_sort(list_distinct(flatten(list(vi)))), '|'), '') AS via, coalesce(array_to_string(list_sort(list_distinct(flatten(list(ev)))), '|'), '') AS event_ids FROM b GROUP BY 1, 2)
      SELECT u.*, coalesce(context_keys, '') AS context_keys FROM u LEFT JOIN ky USING (qid, chunk_id)""",
    "relationship_paths": f"""WITH {_EDGES}, p AS (SELECT qid, from_id AS eid, concat('ActionEvent:', from_id, ' -', etype, '-> ', to_type, ':', to_id) AS path FROM seeds JOIN e ON etype <> 'MENTIONED_IN' AND to_type = vtype AND to_id = vid),
      ev AS (SELECT * FROM (SELECT qid, eid, row_number() OVER (PARTITION BY qid ORDER BY eid) AS k FROM (SELECT DISTINCT qid, eid FROM p)) WHERE k <= 5),
      a AS (SELECT qid, path FROM p UNION SELECT qid, concat('ActionEvent:', from_id, ' -', etype, '-> ', to_type, ':', CASE WHEN length(concat(to_type, ':', to_id)) > 44 THEN 'x' ELSE to_id END) FROM ev JOIN e ON from_type = 'ActionEvent' AND from_id = eid AND etype <> 'MENTIONED_IN')
      SELECT * FROM (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY path) AS position FROM a) WHERE position <= 20""",
    "match_fuzzy": """WITH p AS (SELECT a.vec_id AS qid, b.vec_id AS idx, a.label AS la, b.label AS lb, a.vec_id % 10 AS ia, b.vec_id % 10 AS ib,
      list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
      t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, idx) AS k FROM p),
      s AS (SELECT *, len(list_intersect(list_distinct(['cluster', la::VARCHAR, 'item', ia::VARCHAR, 'extra']), list_distinct(['cluster', lb::VARCHAR, 'item', ib::VARCHAR])))::DOUBLE / len(list_distinct(['cluster', lb::VARCHAR, 'item', ib::VARCHAR])) AS share FROM t WHERE k <= 25),
      q AS (SELECT *, 0.7::DOUBLE * sim + 0.3::DOUBLE * share AS score FROM s WHERE sim >= 0.9 OR (share >= 0.6 AND sim >= 0.8)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, idx DESC) AS n FROM q)
      SELECT qid, CAST(idx AS VARCHAR) AS vid, round(score, 6) AS score FROM r WHERE n = 1""",
    "rank_composite": f"WITH {_SCORED} SELECT qid, chunk_id, rerank, round(fs, 3) AS final_score, sunk FROM z",
    "coverage_verdict": f"""WITH {_SCORED} SELECT qid, graph_chunks, distinct_events, scope_coverage, want::BIGINT AS want,
      CASE WHEN want > 0 THEN CASE WHEN wide THEN 'insufficient_graph' ELSE 'dense_supplemented' END WHEN graph_chunks = 0 THEN 'no_evidence' ELSE 'sufficient' END AS gate FROM nfo""",
    "rank_final": f"""WITH {_SCORED}, dn AS (SELECT qid, concat((qid + k) % (SELECT count(*) FROM documents), '_chunk_0') AS chunk_id, k + 1 AS rank FROM nfo, (SELECT unnest(range(10)) AS k)),
      mo AS (SELECT * FROM (SELECT qid, chunk_id, rank, row_number() OVER (PARTITION BY qid ORDER BY 1 / (1 + exp(-(8.0::DOUBLE * nboth / 4 - 4))) DESC, rank) AS rerank, want FROM dn JOIN tx USING (chunk_id) JOIN nfo USING (qid) WHERE want > 0 AND (qid, chunk_id) NOT IN (SELECT (qid, chunk_id) FROM z)) WHERE rerank <= want),
      a AS (SELECT qid, chunk_id, 'graph' AS source, sunk, rerank, 0 AS topup, pos FROM z UNION ALL SELECT qid, chunk_id, 'dense', false, rerank, 1, rank FROM mo),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sunk, rerank, topup, pos) AS position FROM a)
      SELECT qid, chunk_id, source, position FROM r WHERE position <= CASE WHEN qid % 200 = 0 THEN 16 ELSE 5 END""",
}
