"""Traversal of the property graph for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx

DIRECT_CAP, ROOTS, EVENTS_PER_ROOT, CHUNKS_PER_EVENT, CHUNKS, PATHS, PATH_EVENTS = 25, 4, 40, 2, 90, 20, 5


def around(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds(qid, vtype, vid) -> their relations, seen from the seed: qid, vtype, vid,
    etype, other_type, other_id, forward. The seeds meet the edges before any aggregate."""
    out = edges.select(F.col("from_type").alias("vtype"), F.col("from_id").alias("vid"), "etype", F.col("to_type").alias("other_type"), F.col("to_id").alias("other_id"), F.lit(True).alias("forward"))
    back = edges.select(F.col("to_type").alias("vtype"), F.col("to_id").alias("vid"), "etype", F.col("from_type").alias("other_type"), F.col("from_id").alias("other_id"), F.lit(False).alias("forward"))
    few = seeds.select("qid", "vtype", "vid").distinct()
    return few.join(out, ["vtype", "vid"]).unionByName(few.join(back, ["vtype", "vid"])).distinct()


def chunk_order(chunk: str):
    """Chunks by document, then by number."""
    doc = tx.doc_of_chunk(F.col(chunk))
    return [F.when(doc == "", F.col(chunk)).otherwise(doc), tx.chunk_index(F.col(chunk))]


def _per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def traverse_local(seeds: DataFrame, edges: DataFrame, cap: int = DIRECT_CAP, distinct_events: bool = False) -> DataFrame:
    """seeds(qid, vtype, vid) -> qid, chunk_id, support, via, event_ids.

    A chunk's support counts the seeds that mention it and the (seed, event) pairs
    whose event mentions it (events once each with distinct_events)."""
    seeds = seeds.select("qid", "vtype", "vid").distinct()
    mentions = edges.where("etype = 'MENTIONED_IN'").select(F.col("from_type").alias("vtype"), F.col("from_id").alias("vid"), F.col("to_id").alias("chunk_id"))
    direct = _per_group(seeds.join(mentions, ["vtype", "vid"]).distinct(), ["qid", "vtype", "vid"], chunk_order("chunk_id"), cap)
    near = around(seeds, edges.where("etype <> 'MENTIONED_IN'"))
    # an event seed with a relation is an event of its own
    events = near.where("other_type = 'ActionEvent'").select("qid", "vtype", "vid", F.col("other_id").alias("eid")).union(near.where("vtype = 'ActionEvent'").select("qid", "vtype", "vid", F.col("vid").alias("eid"))).distinct()
    mediated = events.join(mentions.where("vtype = 'ActionEvent'").select(F.col("vid").alias("eid"), "chunk_id"), "eid").distinct()
    rows = direct.select("qid", "chunk_id", F.concat(F.lit("direct:"), "vid").alias("via"), F.lit(None).cast("string").alias("eid"), F.concat_ws(":", "vtype", "vid").alias("way")).union(mediated.select("qid", "chunk_id", F.concat(F.lit("event:"), F.left("eid", F.lit(48))).alias("via"), "eid", F.concat_ws(":", "vtype", "vid").alias("way")))
    support = (F.count_distinct(F.when(F.col("eid").isNull(), F.col("way"))) + F.count_distinct("eid")) if distinct_events else F.count("*")
    return rows.groupBy("qid", "chunk_id").agg(support.cast("long").alias("support"), F.sort_array(F.collect_set("via")).alias("via"), F.sort_array(F.collect_set("eid")).alias("event_ids"))


def roots(members: DataFrame, most: int = ROOTS, least_events: int = 1) -> DataFrame:
    """members(qid, key, display, vid), a row for each event of a matched key -> the
    `most` roots of each query: qid, key, display, level, specificity, n_events, root_rank.
    Events are counted, never gathered."""
    return ranked_roots(_sizes(members, "qid", "key"), most, least_events)


def _sizes(members: DataFrame, *keys: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.min("display").alias("display"), F.count_distinct(F.when(F.col("vid") != "", F.col("vid"))).alias("n_events"))


def of_keys(matched: DataFrame, members: DataFrame, per_root: int = EVENTS_PER_ROOT) -> tuple[DataFrame, DataFrame]:
    """matched(qid, key), members(key, display, vid) -> (qid, key, display, n_events), and
    (qid, key, display, vid) of the first `per_root` events of each key. Both are found once
    for each key, however many questions ask for it."""
    few = members.join(matched.select("key").distinct(), "key", "left_semi")
    first = _per_group(few.where("vid <> ''").groupBy("key", "vid").agg(F.min("display").alias("display")), ["key"], [F.col("vid")], per_root)
    return matched.join(_sizes(few, "key"), "key").select("qid", "key", "display", "n_events"), matched.join(first, "key").select("qid", "key", "display", "vid")


def ranked_roots(size: DataFrame, most: int = ROOTS, least_events: int = 1) -> DataFrame:
    """(qid, key, display, n_events) -> roots()."""
    rows = size.select("qid", "key", "display", cx.key_level(F.col("key")).alias("level"), cx.key_specificity(F.col("key")).alias("specificity"), "n_events").where(F.col("n_events") >= least_events)
    order = Window.partitionBy("qid").orderBy(F.desc("specificity"), F.desc("n_events"), "key")
    return rows.withColumn("root_rank", F.row_number().over(order)).where(F.col("root_rank") <= most)


def candidate_events(ranked: DataFrame, members: DataFrame, per_root: int = EVENTS_PER_ROOT) -> DataFrame:
    """roots() and its members -> qid, eid, event_ord, keys: the first events of each
    root, in order of the roots, with the keys of the roots that have them."""
    rows = members.where(F.coalesce("vid", F.lit("")) != "").select("qid", "key", F.col("vid").alias("eid")).distinct().join(ranked.select("qid", "key", "root_rank"), ["qid", "key"])
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("qid", "key").orderBy("eid"))).where(F.col("pos") <= per_root)
    events = rows.groupBy("qid", "eid").agg(F.min(F.struct("root_rank", "pos")).alias("o"), F.transform(F.sort_array(F.collect_set(F.struct("root_rank", "key"))), lambda x: x["key"]).alias("keys"))
    return events.select("qid", "eid", F.row_number().over(Window.partitionBy("qid").orderBy("o")).alias("event_ord"), "keys")


def traverse_scope(events: DataFrame, edges: DataFrame, per_event: int = CHUNKS_PER_EVENT, most: int = CHUNKS) -> DataFrame:
    """candidate_events() -> qid, chunk_id, support, event_ids, context_keys: events in
    order, `per_event` chunks each, until `most` distinct chunks are found."""
    grounded = edges.where("etype = 'MENTIONED_IN' and from_type = 'ActionEvent'").select(F.col("from_id").alias("eid"), F.col("to_id").alias("chunk_id"))
    pairs = _per_group(events.join(grounded, "eid").distinct(), ["qid", "eid"], chunk_order("chunk_id"), per_event)
    order = [F.col("event_ord"), *chunk_order("chunk_id")]
    first = F.row_number().over(Window.partitionBy("qid", "chunk_id").orderBy(*order)) == 1
    pairs = pairs.withColumn("fresh", F.when(first, 1).otherwise(0))
    before = F.sum("fresh").over(Window.partitionBy("qid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    kept = pairs.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    keys = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("event_ord", "keys"))), lambda x: x["keys"])))
    return kept.groupBy("qid", "chunk_id").agg(F.count_distinct("eid").alias("support"), F.sort_array(F.collect_set(F.concat(F.lit("scope:"), F.left("eid", F.lit(48))))).alias("via"), F.sort_array(F.collect_set("eid")).alias("event_ids"), keys.alias("context_keys"))


def merge_traversals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Supports add up, lists unite."""
    cols = ["qid", "chunk_id", "support", "via", "event_ids", "context_keys"]

    def full(df):
        for c in cols[3:]:
            if c not in df.columns:
                df = df.withColumn(c, F.array().cast("array<string>"))
        return df.select(cols)

    lists = [F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in cols[3:]]
    return full(a).unionByName(full(b)).groupBy("qid", "chunk_id").agg(F.sum("support").cast("long").alias("support"), *lists)


def relationship_paths(seeds: DataFrame, edges: DataFrame, most: int = PATHS, events: int = PATH_EVENTS) -> DataFrame:
    """seeds(qid, vtype, vid) -> qid, path, position: relations of the seeds and of
    their first `events` events, those of events first, `most` for each query."""
    rel = edges.where("etype <> 'MENTIONED_IN'").select("etype", "from_type", "from_id", "to_type", "to_id")
    label = lambda t, i: tx.path_label(F.col(t), F.col(i))
    show = lambda a, b: F.concat(a, F.lit(" -"), "etype", F.lit("-> "), b).alias("path")
    own, other = label("vtype", "vid"), label("other_type", "other_id")
    here = around(seeds, rel).select("qid", F.when(F.col("forward"), show(own, other)).otherwise(show(other, own)).alias("path"), F.when(F.col("forward"), F.struct(F.col("vtype").alias("t"), F.col("vid").alias("i"))).otherwise(F.struct(F.col("other_type").alias("t"), F.col("other_id").alias("i"))).alias("source"))
    # bounded early: at most `most` paths and `events` events of a query go on
    near = _per_group(here.select("qid", "path").distinct(), ["qid"], [F.col("path")], most + events)
    some = _per_group(here.where("source.t = 'ActionEvent'").select("qid", F.col("source.i").alias("eid")).distinct(), ["qid"], [F.col("eid")], events)
    out = rel.where("from_type = 'ActionEvent'")
    more = some.join(out, F.col("eid") == F.col("from_id")).select("qid", show(label("from_type", "from_id"), label("to_type", "to_id")))
    rows = near.select("qid", "path").union(more).distinct()
    first = F.when(F.startswith("path", F.lit("ActionEvent:")), 0).otherwise(1)
    order = Window.partitionBy("qid").orderBy(first, "path")
    return rows.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def mode_of(question_type, n_roots, requested=None):
    """'scope' for collection questions with roots, else 'local'."""
    auto = F.when((question_type == "collection_aggregation") & (n_roots > 0), "scope").otherwise("local")
    if requested is None:
        return auto
    return F.when(requested == "auto", auto).when((requested == "scope") & (n_roots == 0), "local").otherwise(requested)


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with rows put over those of the same keys; of rows that repeat a key in one
    batch the largest by all columns."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    cols = F.struct(*stored.columns)
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(cols, F.struct(F.col("_new"), cols)).alias("r")).select("r.*")


def path_seeds(mode: DataFrame, seeds: DataFrame, events: DataFrame, most: int = 10) -> DataFrame:
    """mode(qid, mode), seeds(qid, vtype, vid), candidate_events() -> where paths start: in
    'scope' the first `most` events of the roots, else the seeds."""
    scope = events.where(F.col("event_ord") <= most).join(mode.where("mode = 'scope'").select("qid"), "qid", "left_semi")
    local = seeds.select("qid", "vtype", "vid").join(mode.where("mode <> 'scope'").select("qid"), "qid", "left_semi")
    return scope.select("qid", F.lit("ActionEvent").alias("vtype"), F.col("eid").alias("vid")).unionByName(local)
