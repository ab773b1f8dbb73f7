"""Graph search, the tools of the investigation loop and the answer, for a batch of questions.

A question batch goes through analysis, matching of mentions and context phrases,
choice of a mode, traversal, lineage of contexts, ranking with its gate, and paths, as
one plan for all questions; each step is a join or an aggregate by question."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.sources.shared import shared_copy

from . import bm25, graph, matching, ranking, rerank, vectors
from .investigate import ACTIONS

#: Words of questions that ask for several things (fixed values).
COLLECTION_WORDS = r"(?i)\b(how many|which of|list|all|every|each|count|total|number of|both)\b"
LOCAL, WHOLE_QUERY = "local_fact", 220


class Search(NamedTuple):
    chunks: DataFrame  # qid, chunk_id, source, support, rerank, final_score, position
    seeds: DataFrame  # qid, vtype, vid, mention_ord
    unmatched: DataFrame  # qid, mention_ord, mention
    roots: DataFrame  # qid, key, display, level, specificity, n_events, root_rank
    info: DataFrame  # one row a question: mode, counts, coverage and gate
    relationships: DataFrame  # qid, path, position


def analyse(questions: DataFrame) -> DataFrame:
    """questions(qid, query) with question_type, by the words they use: the offline
    stand-in for a model's analysis."""
    return questions.withColumn("question_type", F.when(F.regexp_like("query", F.lit(COLLECTION_WORDS)), ranking.COLLECTION).otherwise(LOCAL))


def plan(questions: DataFrame, slots: DataFrame) -> DataFrame:
    """slots(qid, slot, question, slot_type) of a planner; a question without any gets
    itself as the single slot s1."""
    none = questions.join(slots.select("qid"), "qid", "left_anti")
    spare = none.select("qid", F.lit("s1").alias("slot"), F.col("query").alias("question"), F.lit("relational").alias("slot_type"))
    return slots.select("qid", "slot", "question", "slot_type").unionByName(spare)


def resolve_contexts(phrases: DataFrame, members: DataFrame, keys: DataFrame | None = None, most: int = graph.ROOTS) -> tuple[DataFrame, DataFrame]:
    """(roots, first members of the matched keys): phrases(qid, phrase), members(key, display,
    vid), keys(key, display [, embedding])."""
    keys = members.groupBy("key").agg(F.min("display").alias("display")) if keys is None else keys
    matched = shared_copy(matching.match_contexts(phrases, keys).select("qid", "key").distinct(), "asked-keys")
    sizes, first = graph.of_keys(matched, members)
    return shared_copy(graph.ranked_roots(sizes, most), "roots"), shared_copy(first, "members")


def mentions_of(questions: DataFrame, whole_query: bool = True) -> DataFrame:
    """qid, mention_ord, mention: the mentions in order, then the query itself."""
    listed = F.coalesce(F.col("mentions"), F.array().cast("array<string>"))
    every = F.concat(listed, F.array(F.left("query", F.lit(WHOLE_QUERY)))) if whole_query else listed
    return questions.select("qid", F.posexplode(every).alias("mention_ord", "mention"))


def graph_search(questions: DataFrame, index: DataFrame, members: DataFrame, edges: DataFrame, texts: DataFrame, dense: DataFrame | None = None, mode: str = "auto", keys: DataFrame | None = None, scorer=rerank.overlap_logit) -> Search:
    """questions(qid, query, question_type, mentions, phrases), entity_index(), context
    members(key, display, vid), edges, texts(chunk_id, text), dense(qid, chunk_id, rank).

    Questions that ask for a collection and have a context root are searched by scope,
    their seeds' neighbourhoods added; the others by their seeds alone."""
    asked = mentions_of(questions)
    matched = shared_copy(matching.match_entities(asked, index), "matched")
    seeds = shared_copy(matching.seeds(matched), "seeds")
    phrases = questions.select("qid", F.explode(F.coalesce(F.col("phrases"), F.array().cast("array<string>"))).alias("phrase"))
    roots, mine = resolve_contexts(phrases, members, keys)
    n = lambda df, name: df.groupBy("qid").agg(F.count("*").alias(name))
    about = questions.select("qid", "query", "question_type").join(n(roots, "n_roots"), "qid", "left").join(n(seeds, "n_seeds"), "qid", "left").na.fill(0, ["n_roots", "n_seeds"])
    about = shared_copy(about.withColumn("mode", graph.mode_of(F.col("question_type"), F.col("n_roots"), None if mode == "auto" else F.lit(mode))), "about")
    wide = roots.join(about.where("mode = 'scope'").select("qid"), "qid", "left_semi")
    events = shared_copy(graph.candidate_events(wide, mine), "scope-events")
    found = shared_copy(graph.merge_traversals(graph.traverse_scope(events, edges), graph.traverse_local(seeds, edges)), "found")
    requested = roots.groupBy("qid").agg(F.sort_array(F.collect_set("key")).alias("requested_keys"))
    collection = F.col("question_type") == ranking.COLLECTION
    ranked_as = about.select("qid", "query", F.when(F.col("n_roots") > 0, F.col("question_type")).alias("question_type"), F.when(collection, ranking.COLLECTION_TOP_N).otherwise(ranking.TOP_N).alias("top_n")).join(requested, "qid", "left")
    ranked_as = shared_copy(ranked_as.withColumn("requested_keys", F.coalesce("requested_keys", F.array().cast("array<string>"))), "ranked-as")
    chunks = shared_copy(ranking.rank_chunks(found, texts, ranked_as, dense, scorer), "ranked")
    kinds = chunks.groupBy("qid").agg(F.count_if(F.col("source") == "dense").alias("dense_topup"), F.count("*").alias("final_chunks"))
    n_found = found.join(texts.select("chunk_id"), "chunk_id", "left_semi").groupBy("qid").agg(F.count("*").alias("graph_chunks"))
    info = about.drop("query").join(n(events, "scope_events"), "qid", "left").join(n_found, "qid", "left").join(ranking.missing(found, texts), "qid", "left").join(kinds, "qid", "left")
    info = info.na.fill(0, ["scope_events", "graph_chunks", "missing_chunks", "dense_topup", "final_chunks"])
    paths = graph.relationship_paths(graph.path_seeds(about.select("qid", "mode"), seeds, events), edges)
    return Search(chunks, seeds, matching.unmatched(asked, matched), roots, info, paths)


class Corpus(NamedTuple):
    """What the tools search: see graph_search(); chunks(chunk_id, doc_id, text, title, url)."""

    index: DataFrame
    members: DataFrame
    edges: DataFrame
    chunks: DataFrame


def _evidence(rows: DataFrame, source: Column, support: Column, score: Column, event: Column) -> DataFrame:
    return rows.select("qid", "chunk_id", event.alias("event_id"), "text", support.cast("long").alias("support"), score.cast("double").alias("rerank_score"), source.alias("source"))


def vector_hits(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Dense hits by hashed vectors of the cleaned queries: qid, id, similarity, rank."""
    stored = vectors.hash_vectors(chunks, "chunk_id", F.col("text"))
    asked = vectors.hash_vectors(questions, "qid", tx.clean_query(F.col("query"))).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return vectors.nearest(asked, stored)


def tools(questions: DataFrame, corpus: Corpus) -> dict:
    """The four tools of investigate.run(): each takes the state rows that chose it and
    gives evidence (qid, chunk_id, event_id, text, support, rerank_score, source)."""
    texts = corpus.chunks.select("chunk_id", "text")

    def of(state):
        return questions.join(state.select("qid", "target_context"), "qid")

    def by_graph(state, mode):
        q = of(state)
        if mode == "scope":
            q = q.withColumn("phrases", F.when(F.col("target_context").isNotNull(), F.array("target_context")).otherwise(F.col("phrases")))
        got = graph_search(q.drop("target_context"), corpus.index, corpus.members, corpus.edges, texts, mode=mode)
        return _evidence(got.chunks.join(texts, "chunk_id"), F.lit("graph"), F.col("support"), F.col("final_score"), F.lit(None).cast("string"))

    def by_vector(state):
        q = of(state)
        rows = rerank.hybrid(q, corpus.chunks, vector_hits(q, corpus.chunks), id_col="chunk_id").withColumnRenamed("id", "chunk_id")
        return _evidence(rows, F.lit("vector"), F.lit(0), F.col("rerank_score"), F.lit(None).cast("string"))

    def by_community(state):
        hits = bm25.top(bm25.scores(corpus.chunks, of(state), "chunk_id"))
        rows = ranking.community(hits.join(corpus.chunks.select(F.col("chunk_id").alias("id"), "doc_id", "text", "title", "url"), "id"))
        rows = rows.select("qid", F.col("doc_id").alias("chunk_id"), F.col("sample").alias("text"), "chunk_count")
        return _evidence(rows, F.lit("community"), F.col("chunk_count"), F.lit(None), F.lit(None).cast("string"))

    calls = (lambda s: by_graph(s, "auto"), lambda s: by_graph(s, "scope"), by_vector, by_community)
    return dict(zip(ACTIONS, calls))


def judge_slots(slots: DataFrame, evidence: DataFrame, enough: float = 0.6, some: float = 0.3) -> DataFrame:
    """slots(qid, slot, question), evidence(qid, text) -> qid, slot, support_score, status:
    the best share of a slot's tokens that one text has; the offline evaluator."""
    pairs = slots.join(evidence.select("qid", "text"), "qid", "left")
    share = matching.overlap(F.array_join(tx.tokens(F.col("text")), " "), F.array_join(tx.tokens(F.col("question")), " "))
    best = pairs.groupBy("qid", "slot").agg(F.round(F.max(share), 4).alias("support_score"))
    score = F.coalesce("support_score", F.lit(0.0))
    return best.select("qid", "slot", score.alias("support_score"), F.when(score >= enough, "supported").when(score >= some, "partial").otherwise("missing").alias("status"))


def answer(context: DataFrame, chars: int = 300, cites: int = 3) -> DataFrame:
    """build_context() rows -> qid, predicted, citations, evidence_sufficient, confidence:
    the start of the best chunk, the offline answer."""
    rows = context.groupBy("qid").agg(F.min_by("text", "position").alias("text"), F.count("*").alias("n"), F.max("rerank_score").cast("double").alias("confidence"), F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col("position") <= cites, F.struct("position", "chunk_id")))), 1, cites), lambda x: x["chunk_id"]).alias("citations"))
    return rows.select("qid", tx.strip(F.left("text", F.lit(chars))).alias("predicted"), "citations", (F.col("n") >= cites).alias("evidence_sufficient"), "confidence")


def last_steps(trace: DataFrame, most: int = 6) -> DataFrame:
    """The last steps of each question's trace(qid, step, ...), in order."""
    back = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("step")))
    return trace.withColumn("_n", back).where(F.col("_n") <= most).drop("_n")
