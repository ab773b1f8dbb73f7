"""Cosine, exact nearest neighbours and embedding seams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import tokens

TOP = 20
#: A block of query vectors that one broadcast may hold (rows).
QUERY_BLOCK = 4096


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; vectors of different lengths raise."""
    size = norm(a) * norm(b)
    value = F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(value)


def unit(v: Column, least: float = 1e-10) -> Column:
    n = F.greatest(norm(v), F.lit(least))
    return F.transform(_doubles(v), lambda x: x / n)


def nearest(queries: DataFrame, stored: DataFrame, k: int = TOP, where: Column | None = None) -> DataFrame:
    """queries(qid, qvec), stored(id, embedding, ...) -> qid, id, distance,
    similarity, rank: exact, all queries against all rows, in blocks.

    A block of at most QUERY_BLOCK query vectors is broadcast as one matrix; each
    task multiplies its batches with it and keeps its own k best per query, so the
    shuffle holds k rows per query and task, whatever the corpus."""
    if k <= 0:
        raise ValueError("k must be positive")
    stored = stored if where is None else stored.where(where)
    schema = T.StructType([T.StructField("qid", queries.schema["qid"].dataType), T.StructField("id", stored.schema["id"].dataType), T.StructField("similarity", T.DoubleType())])
    spark, out = stored.sparkSession, None
    for block in _blocks(queries, QUERY_BLOCK):
        shared = spark.sparkContext.broadcast((block["qid"].tolist(), np.array(block["qvec"].tolist(), np.float64)))
        one = stored.select("id", "embedding").mapInPandas(_best(shared, k, schema.names), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("qid", "id", (F.lit(1.0) - F.col("similarity")).alias("distance"), "similarity", "rank")


def _blocks(queries: DataFrame, size: int):
    """The query vectors, a bounded block at a time."""
    rows = []
    for r in queries.select("qid", "qvec").orderBy("qid").toLocalIterator():
        rows.append((r["qid"], [float(x) for x in r["qvec"]]))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=["qid", "qvec"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["qid", "qvec"])


def _best(shared, k, names):
    def run(batches):
        qids, q = shared.value
        qn = np.linalg.norm(q, axis=1)
        ids, sims = [np.zeros(0, object)] * len(qids), [np.zeros(0)] * len(qids)
        for batch in batches:
            if not len(batch):
                continue
            x = np.array(batch["embedding"].tolist(), np.float64)
            if x.shape[1] != q.shape[1]:
                raise ValueError("vectors differ in length")
            size = qn[:, None] * np.linalg.norm(x, axis=1)[None, :]
            s = np.divide(q @ x.T, size, out=np.zeros_like(size), where=size > 0)
            own = batch["id"].to_numpy()
            for i in range(len(qids)):
                both, score = np.concatenate((ids[i], own)), np.concatenate((sims[i], s[i]))
                keep = np.lexsort((both.astype(own.dtype), -score))[:k]
                ids[i], sims[i] = both[keep], score[keep]
        for i, qid in enumerate(qids):
            if len(ids[i]):
                yield pd.DataFrame({names[0]: [qid] * len(ids[i]), names[1]: ids[i].tolist(), names[2]: sims[i]})

    return run


def hash_vectors(docs: DataFrame, id_col: str, text: Column, dim: int = 64) -> DataFrame:
    """id, embedding: counts of hashed tokens with signs, the offline embedder. One
    aggregate and no Python; a text without tokens has the zero vector."""
    digit = lambda h, i: F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1
    toks = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(F.array(F.lit("")), tokens(text))).alias("tok"))
    h = F.md5(F.col("tok").cast("binary"))
    coded = toks.select("id", F.when(F.col("tok") != "", ((digit(h, 1) * 16 + digit(h, 2)) * 16 + digit(h, 3)) * 16 + digit(h, 4)).alias("h"))
    slot, sign = F.col("h") % dim, F.when(F.floor(F.col("h") / dim) % 2 == 0, 1).otherwise(-1)
    parts = [F.coalesce(F.sum(F.when(slot == i, sign)), F.lit(0)).cast("double") for i in range(dim)]
    return coded.groupBy("id").agg(F.array(*parts).alias("embedding"))


def hash_embedder(dim: int = 64):
    """text -> unit vector of hashed words, as a pandas UDF: the seam for models that
    Spark cannot run. Empty text raises."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re
        import zlib

        out = []
        for t in texts:
            if not t or not t.strip():
                raise ValueError("cannot embed an empty text")
            v = np.zeros(dim)
            for w in re.findall("[a-z0-9]+", t.lower()):
                h = zlib.crc32(w.encode())
                v[h % dim] += 1 if h & 0x80000000 else -1
            out.append((v / max(np.linalg.norm(v), 1e-10)).astype(np.float32))
        return pd.Series(out)

    return embed
