"""Queries over text, ingestion and retrieval, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx
from lodestone.operators import bm25, ingest, ranking, rerank, splitter, vectors

from . import fixtures as fx
from . import sql


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _questions(spark, sf_dir):
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def _titled(spark, sf_dir):
    return fx.view(spark, sf_dir, fx.TITLED, "documents")


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.clean_text(F.col("text")).alias("clean"))


def clean_query_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", tx.clean_query(F.col("html")).alias("clean"))


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = tx.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("tokens"))


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", tx.normalize_name(F.col("text")).alias("name"), tx.norm_key(F.col("text")).alias("name_key"))


def normalize_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.normalize_answer(F.col("text")).alias("answer"))


def corpus_dedup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stand for ids here, since the fixture's ids never repeat."""
    rows = _docs(spark, sf_dir).select(F.sha2("text", 256).alias("doc_id"), F.lit("t").alias("title"), "text", F.col("doc_id").alias("ordinal"))
    return ingest.corpus(rows).select(F.col("ordinal").alias("doc_id"), F.length("text").cast("long").alias("n_chars"))


def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text")
    rows = ingest.fixed_windows(docs)
    return rows.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), "page")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(_docs(spark, sf_dir)).terms.select("term", F.col("df").cast("long").alias("df"))


def bm25_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.build(_docs(spark, sf_dir)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


def _bm25(spark, sf_dir):
    return bm25.scores(_docs(spark, sf_dir), _questions(spark, sf_dir)).withColumn("bm25_score", F.round("bm25_score", 6))


def bm25_topm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.top(_bm25(spark, sf_dir)).select("qid", F.col("id").alias("doc_id"), "bm25_score", F.col("rank").cast("long").alias("rank"))


def bm25_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-word queries, so that some have fewer matches than the limit."""
    words = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("query"))
    docs = _docs(spark, sf_dir)
    scored = bm25.scores(docs, words).withColumn("bm25_score", F.round("bm25_score", 6))
    return bm25.top_filled(scored, docs, words).select("qid", F.col("id").alias("doc_id"), "bm25_score", F.col("rank").cast("long").alias("rank"))


def _dense(spark, sf_dir, where=None):
    e = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    hits = vectors.nearest(q, e, where=where)
    return hits.select("qid", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir)


def dense_topk_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, F.col("label") == 3)


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


def _dense_hits(spark, sf_dir):
    """The documents nearest to the questions: cleaned, embedded, searched exactly."""
    stored = vectors.hash_vectors(_docs(spark, sf_dir), "doc_id", F.col("text"))
    asked = vectors.hash_vectors(_questions(spark, sf_dir), "qid", tx.clean_query(F.col("query"))).select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    return vectors.nearest(asked, stored)


def query_embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _dense_hits(spark, sf_dir)
    return hits.select("qid", F.col("id").alias("doc_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


def hybrid_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = bm25.top(_bm25(spark, sf_dir))
    both = ingest.union_first(_dense_hits(spark, sf_dir).withColumn("source", F.lit("dense")), sparse.withColumn("source", F.lit("bm25")), key="id")
    return both.select("qid", F.col("id").alias("doc_id"), "source", F.col("position").cast("long").alias("position"))


def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rerank.hybrid(_questions(spark, sf_dir), _docs(spark, sf_dir), _dense_hits(spark, sf_dir))
    return rows.select("qid", F.col("id").alias("doc_id"), F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank").cast("long").alias("rerank"))


def community_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources play the documents whose chunks the texts are."""
    docs = _table(spark, sf_dir, "documents")
    hits = bm25.top(_bm25(spark, sf_dir))
    rows = hits.join(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("doc_id"), "text", F.col("lang").alias("title"), F.lit("").alias("url")), "id")
    out = ranking.community(rows)
    return out.select("qid", "doc_id", "chunk_count", F.col("best_rank").cast("long").alias("best_rank"), "sample", "title", F.col("place").cast("long").alias("place"))


def derive_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir).select("doc_id", "title")
    c = cx.with_context(rows, "title", cx.sports(rows), "c")
    return c.select("doc_id", F.col("c.root_context").alias("root_context"), F.array_join("c.context_path", "|").alias("path"), F.array_join("c.context_keys", "|").alias("context_keys"), F.col("c.context_level").alias("context_level"))


def sports_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cx.sports(_titled(spark, sf_dir))


def topup_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id")
    return ingest.new_rows(docs, _table(spark, sf_dir, "labels"), "doc_id")


def lookup_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return ingest.missing(wanted, _table(spark, sf_dir, "documents"), "doc_id")


def title_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _titled(spark, sf_dir).select(F.col("source").alias("doc_id"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.col("doc_id").alias("chunk_index"))
    return ingest.titles(rows)


def embed_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.hash_vectors(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return rows.select(F.col("id").alias("doc_id"), F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("embedding"))


def lookup_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    return ingest.lookup(_table(spark, sf_dir, "documents"), wanted, "doc_id").select("doc_id", "source")


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _titled(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "title", "text")
    return splitter.chunks(docs).select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), "page")


def eval_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents before the others, each part in its own order."""
    docs, gold = _table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").select("doc_id")
    return ingest.wanted_first(docs, gold, "doc_id", "doc_id").select("doc_id", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (clean_text, clean_query_html, tokenize, normalize_name, normalize_answer, corpus_dedup_filter, chunk_fixed_window, bm25_stats, bm25_corpus, bm25_topm, bm25_zero_fill, dense_topk, dense_topk_where, unit_vectors, hybrid_dedup, hybrid_rerank, community_search, derive_context, sports_vocab, topup_anti_join, lookup_missing, lookup_found, title_projection, embed_hash, query_embed_search, chunk_recursive, eval_first)}

_SCORES = f"""
tok AS (SELECT doc_id, {sql.tokens('text')} AS t FROM documents),
dl AS (SELECT doc_id, len(t) AS dl FROM tok), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({sql.tokens(sql.clean_query('query'))}) AS term FROM asked) GROUP BY 1, 2),
scored AS (SELECT qid, doc_id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS bm25_score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN c GROUP BY 1, 2)"""
_TOP = "ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, doc_id) AS rank FROM scored)"
_ASKED = "asked AS (SELECT item_id AS qid, text AS query FROM benchmark)"
_TITLED = fx.duck(fx.TITLED)
_COS = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
_KNN = "SELECT * FROM (SELECT a.vec_id AS qid, b.vec_id, round({cos}, 6) AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {where}) WHERE rank <= 20"
_DIGIT = "(instr('0123456789abcdef', substr(md5(tok), {i}, 1)) - 1)"
_HASH = f"((({_DIGIT.format(i=1)} * 16 + {_DIGIT.format(i=2)}) * 16 + {_DIGIT.format(i=3)}) * 16 + {_DIGIT.format(i=4)})"


def _vectors_sql(name: str, source: str, key: str, text: str) -> str:
    """CTE name(key, v): the hashed token counts of a table's texts."""
    return f"""{name}_h AS (SELECT {key}, {_HASH} AS h FROM (SELECT {key}, unnest({sql.tokens(text)}) AS tok FROM {source})),
{name}_c AS (SELECT {key}, h % 64 AS slot, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS n FROM {name}_h GROUP BY 1, 2),
{name} AS (SELECT s.{key}, list(coalesce(n, 0)::BIGINT ORDER BY i) AS v FROM (SELECT {key}, i FROM {source}, (SELECT unnest(range(64)) AS i)) s LEFT JOIN {name}_c c ON c.{key} = s.{key} AND c.slot = s.i GROUP BY 1)"""


_SIZE = "sqrt(list_sum(list_transform({v}, lambda x: x * x))::DOUBLE)"
_SECOND = f"""{_vectors_sql('dv', 'documents', 'doc_id', 'text')}, {_vectors_sql('qv', 'asked', 'qid', sql.clean_query('query'))},
sim AS (SELECT qid, doc_id, CASE WHEN {_SIZE.format(v='q.v')} * {_SIZE.format(v='d.v')} = 0 THEN 0 ELSE list_sum(list_transform(range(1, 65), lambda i: q.v[i] * d.v[i]))::DOUBLE / ({_SIZE.format(v='q.v')} * {_SIZE.format(v='d.v')}) END AS similarity FROM qv q, dv d),
second AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM sim) WHERE rank <= 20)"""
_UNITED = "united AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l, rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY qid, doc_id ORDER BY l, rank) AS k FROM (SELECT qid, doc_id, rank, 'dense' AS source, 0 AS l FROM second UNION ALL SELECT qid, doc_id, rank, 'bm25', 1 FROM ranked WHERE rank <= 20)) WHERE k = 1)"
_HEAD = "concat('Title: ', title, chr(10), chr(10))"


def _context_sql() -> str:
    edition, canon = r"(?i)\b(\d{4})\s+(Summer|Winter)\s+Olympics\b", cx.CANONICAL
    trim = lambda x: f"trim({x}, ' ,–-')"
    rounds = lambda x: trim(sql.rx(sql.rx(sql.rx(x, cx.ROUND_PREFIX, ""), cx.ROUND_SUFFIX, ""), cx.BOILERPLATE, ""))
    q = sql.quote
    return f"""
WITH t AS ({_TITLED}), v AS (SELECT DISTINCT trim(regexp_extract(title, {q(canon)}, 1)) AS sport FROM t WHERE regexp_extract(title, {q(canon)}, 1) <> ''),
a AS (SELECT doc_id, title, regexp_extract(title, {q(edition)}, 0) AS m, regexp_extract(title, {q(edition)}, 1) AS y, regexp_extract(title, {q(edition)}, 2) AS season, regexp_extract(title, {q(canon)}, 1) AS slot, regexp_extract(title, {q(canon)}, 4) AS ev FROM t),
b AS (SELECT *, slot <> '' AND NOT regexp_matches(slot, {q(cx.EVENTISH)}) AS canonical, CASE WHEN m = '' THEN 0 ELSE strpos(title, m) END AS pos_ FROM a),
c AS (SELECT *, {rounds(sql.rx("left(title, pos_ - 1)", cx.CONNECTOR_TAIL, ""))} AS before_, {rounds(trim(sql.rx("substr(title, pos_ + length(m))", cx.CONNECTOR_HEAD, "")))} AS after_ FROM b),
s AS (SELECT doc_id, arg_min(v.sport, (-length({sql.name('v.sport')}), v.sport)) AS found FROM c JOIN v ON contains(concat(' ', {sql.name('title')}, ' '), concat(' ', {sql.name('v.sport')}, ' ')) WHERE NOT canonical AND m <> '' GROUP BY 1),
d AS (SELECT c.*, coalesce(found, '') AS loose, CASE WHEN after_ <> '' THEN after_ ELSE before_ END AS ev0 FROM c LEFT JOIN s USING (doc_id)),
e AS (SELECT *, CASE WHEN canonical THEN slot ELSE loose END AS sport, CASE WHEN canonical THEN {rounds('ev')} WHEN loose = '' OR ev0 = '' THEN ev0 WHEN {sql.name('ev0')} = {sql.name('loose')} THEN ''
  WHEN contains(concat(' ', {sql.name('ev0')}, ' '), concat(' ', {sql.name('loose')}, ' ')) THEN {rounds("concat(left(ev0, strpos(lower(ev0), lower(loose)) - 1), substr(ev0, strpos(lower(ev0), lower(loose)) + length(loose)))")} ELSE ev0 END AS ev1 FROM d),
f AS (SELECT *, concat(y, ' ', season, ' Olympics') AS root, {rounds('ev1')} AS ev2 FROM e),
g AS (SELECT *, CASE WHEN {sql.name('ev2')} IN ('', {sql.name('sport')}, {sql.name('root')}) THEN '' ELSE ev2 END AS event FROM f)
SELECT doc_id, CASE WHEN m = '' THEN title ELSE root END AS root_context,
  CASE WHEN m = '' THEN title ELSE concat(root, CASE WHEN sport <> '' THEN '|' || sport ELSE '' END, CASE WHEN event <> '' THEN '|' || event ELSE '' END) END AS path,
  CASE WHEN m = '' THEN concat('topic:', replace({sql.name('title')}, ' ', '_'), CASE WHEN regexp_extract(title, {q(cx.YEAR)}, 1) <> '' THEN '|year:' || regexp_extract(title, {q(cx.YEAR)}, 1) ELSE '' END)
    ELSE concat('olympics:', y, CASE WHEN sport <> '' THEN '|sport:' || replace({sql.name('sport')}, ' ', '_') ELSE '' END, CASE WHEN event <> '' THEN '|event:' || replace({sql.name('event')}, ' ', '_') ELSE '' END) END AS context_keys,
  CASE WHEN m = '' THEN 'edition' WHEN event <> '' THEN 'event' WHEN sport <> '' THEN 'sport' ELSE 'edition' END AS context_level FROM g
"""


SQL = {
    "clean_text": f"SELECT doc_id, {sql.clean_text('text')} AS clean FROM documents",
    "clean_query_html": f"SELECT page_id, {sql.clean_query('html')} AS clean FROM pages",
    "tokenize": f"SELECT doc_id, len({sql.tokens('text')})::BIGINT AS n_tokens, array_to_string({sql.tokens('text')}, ' ') AS tokens FROM documents",
    "normalize_name": f"SELECT item_id, {sql.name('text')} AS name, replace({sql.name('text')}, ' ', '_') AS name_key FROM benchmark",
    "normalize_answer": f"SELECT doc_id, {sql.answer('text')} AS answer FROM documents",
    "corpus_dedup_filter": f"SELECT doc_id, length({sql.clean_text('text')})::BIGINT AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1 AND length({sql.clean_text('text')}) >= 30",
    "chunk_fixed_window": rf"""
WITH t AS ({_TITLED}), w AS (SELECT doc_id, title, regexp_extract_all(text, '\S+') AS ws, greatest(50, 512 - len(regexp_extract_all(concat('Title: ', title), '\S+'))) AS size FROM t),
p AS (SELECT *, unnest(range(0, greatest(len(ws) - 54 - 1, 0) + 1, size - 54)) AS pos_ FROM w WHERE len(ws) > 0),
b AS (SELECT doc_id, title, (pos_ / (size - 54))::BIGINT AS chunk_index, ws[pos_ + 1 : pos_ + size] AS part FROM p)
SELECT concat(doc_id, '_chunk_', chunk_index) AS chunk_id, chunk_index, len(part)::BIGINT AS token_count, CASE WHEN starts_with(array_to_string(part, ' '), {_HEAD}) THEN array_to_string(part, ' ') ELSE concat({_HEAD}, array_to_string(part, ' ')) END AS page FROM b""",
    "bm25_stats": f"SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY 1",
    "bm25_corpus": f"SELECT count(*) AS n, round(avg(len({sql.tokens('text')})), 6) AS avgdl FROM documents",
    "bm25_topm": f"WITH {_ASKED}, {_SCORES}, {_TOP} SELECT qid, doc_id, bm25_score, rank FROM ranked WHERE rank <= 20",
    "bm25_zero_fill": f"""WITH asked AS (SELECT p_partkey AS qid, p_name AS query FROM part), {_SCORES}, live AS (SELECT DISTINCT qid FROM qt),
few AS (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 40), al AS (SELECT qid, doc_id, bm25_score FROM scored UNION ALL SELECT qid, doc_id, 0.0 FROM live CROSS JOIN few WHERE (qid, doc_id) NOT IN (SELECT (qid, doc_id) FROM scored)),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, doc_id) AS rank FROM al) SELECT qid, doc_id, bm25_score, rank FROM r WHERE rank <= 20""",
    "dense_topk": _KNN.format(cos=_COS, where="true"),
    "dense_topk_where": _KNN.format(cos=_COS, where="b.label = 3"),
    "unit_vectors": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS first FROM embeddings",
    "hybrid_dedup": f"WITH {_ASKED}, {_SCORES}, {_TOP}, {_SECOND}, {_UNITED} SELECT qid, doc_id, source, position FROM united",
    "hybrid_rerank": f"""WITH {_ASKED}, {_SCORES}, {_TOP}, {_SECOND}, {_UNITED},
x AS (SELECT u.qid, u.doc_id, position, list_distinct({sql.tokens('query')}) AS q, list_distinct({sql.tokens('text')}) AS d FROM united u JOIN asked USING (qid) JOIN documents USING (doc_id)),
y AS (SELECT *, 1 / (1 + exp(-(8.0::DOUBLE * len(list_intersect(q, d)) / greatest(len(q), 1) - 4))) AS s FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, position) AS rerank FROM y)
SELECT qid, doc_id, round(s, 6) AS rerank_score, rerank FROM z WHERE rerank <= 5""",
    "community_search": f"""WITH {_ASKED}, {_SCORES}, {_TOP}, g AS (SELECT qid, source AS doc_id, count(*) AS chunk_count, min(rank) AS best_rank, arg_min(left(text, 400), rank) AS sample, arg_max(lang, rank) AS title FROM ranked JOIN documents USING (doc_id) WHERE rank <= 20 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY best_rank) AS place FROM g) SELECT * FROM r WHERE place <= 5""",
    "derive_context": _context_sql(),
    "sports_vocab": f"SELECT DISTINCT trim(regexp_extract(title, {sql.quote(cx.CANONICAL)}, 1)) AS sport FROM ({_TITLED}) WHERE regexp_extract(title, {sql.quote(cx.CANONICAL)}, 1) <> ''",
    "topup_anti_join": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "lookup_missing": "SELECT DISTINCT c_custkey AS doc_id FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM documents)",
    "lookup_found": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT c_custkey FROM customer)",
    "embed_hash": f"WITH {_vectors_sql('dv', 'documents', 'doc_id', 'text')} SELECT doc_id, array_to_string(v, ',') AS embedding FROM dv",
    "query_embed_search": f"WITH {_ASKED}, {_SECOND} SELECT qid, doc_id, round(similarity, 6) AS similarity, rank FROM second",
    "eval_first": "SELECT doc_id, row_number() OVER (ORDER BY doc_id NOT IN (SELECT doc_id FROM labels), doc_id) AS place FROM documents",
    "title_projection": f"SELECT source AS doc_id, arg_min(title, doc_id) AS title FROM ({_TITLED}) WHERE doc_id % 4 <> 0 GROUP BY 1",
}
