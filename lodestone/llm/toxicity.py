"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Fitting: a bounded sample of the labelled rows (`examples` rows by hash of the id, and
as many of them as have `cells` distinct words together) spans the space: every word
of every example is a coordinate, a hash of 64 bits. A word weighs (1 + log tf) * idf,
scaled by g / (g + `gain`) squared, where g is the likelihood ratio of its occurrence
in toxic and other examples, so that words that tell nothing still count a little and
none is left out. The examples become a block-max inverted index: like examples are
neighbours, a word's postings hold its weight in each example, and for the words that
many examples have every block of examples knows the largest weight.

Scoring: the postings of the rarer words are summed exactly; adding to that, for each
block, query weight times block maximum of the frequent words bounds the cosine of all
its examples. The blocks of the largest bounds are scored first, then all those whose
bound reaches the k-th best cosine found, so the neighbours are exact. They vote with
weight 1 / (1 - cosine + `soften`), and isotonic regression over leave-one-out votes
of the examples turns votes into calibrated scores. Documents go through in batches,
the frequent words as products of dense matrices.

Defined results: null texts and texts that share no word with an example take the
examples' rate of toxic ones; labels other than 0 and 1 and null ids are ignored; a
doc_id with several labels counts as toxic if one says so, one with several rows as
one example with all their words; without any labelled example every score is 0;
neighbours that tie are taken in order of the index; repeated rows are scored each; an
empty table gives an empty result; extra columns are kept by without_toxic().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import release, saved, slices

EXAMPLES, CELLS, GAIN, NEIGHBOURS, SOFTEN, BLOCK, BATCH, POSTINGS = 4000, 2_000_000, 30.0, 25, 0.05, 32, 64, 200_000
OUT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("toxic", T.IntegerType())])))])


def letters_table() -> np.ndarray:
    """True for ASCII letters and bytes of non-ASCII characters."""
    t = tc.alnum_table()
    t[0x30:0x3A] = False
    return t


def term_counts(col, rows: int, most: int = 1 << 20):
    """Yield (first row, rows, row of each term, term, count) for at most `rows` texts
    of a string column at a time; the terms of a row are distinct and sorted."""
    raw, off = tc.buffers(pc.utf8_lower(col))
    table = letters_table()
    for x, y in slices(np.diff(off).tolist(), most):
        for a in range(x, y, rows):
            b = min(y, a + rows)
            part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            if not len(part):
                none = np.zeros(0, np.int64)
                yield a, b - a, none, none.astype(np.uint64), none
                continue
            s, e, to = tc.words(part, at, table)
            h = tc.word_hashes(part, s, e, 21)
            row = np.repeat(np.arange(b - a), np.diff(to))
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            yield a, b - a, row[first], h[first], np.diff(np.append(first, len(h)))


def _example_terms(batches):
    """doc_id, toxic, text -> doc_id, toxic, terms, counts"""
    for batch in batches:
        for a, n, row, h, count in term_counts(batch.column(2), 256):
            ends = np.searchsorted(row, np.arange(n + 1))
            parts = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
            terms, counts = tc.list_array([h[i:j].view(np.int64) for i, j in parts], pa.int64()), tc.list_array([count[i:j] for i, j in parts], pa.int64())
            yield pa.record_batch([batch.column(0).slice(a, n), batch.column(1).slice(a, n), terms, counts], names=["doc_id", "toxic", "terms", "counts"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, cells: int = CELLS, gain: float = GAIN, k: int = NEIGHBOURS, soften: float = SOFTEN, block: int = BLOCK) -> dict:
    """Learn from the rows of `labels` (doc_id, label) that documents have. At most
    `examples` rows with `cells` words together reach the driver."""
    given = labels.select(F.col("doc_id").cast("long").alias("_l"), F.col(label_col).cast("int").alias("toxic")).where("_l is not null and toxic in (0, 1)")
    given = given.groupBy("_l").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_l"), "_l").limit(examples)
    given = saved(given, "labelled")  # bounded by `examples` rows of two numbers
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(given), F.col("doc_id") == F.col("_l"))
    rows = saved(rows.select("doc_id", "toxic", "text").mapInArrow(_example_terms, "doc_id long, toxic int, terms array<long>, counts array<long>"), "example-terms")
    # rows of one id are one example; ids in hash order until the cells are used up
    sizes = rows.groupBy("doc_id").agg(F.sum(F.size("terms")).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    room = np.cumsum([r["n"] for r in sizes]) <= cells
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"],) for r, ok in zip(sizes, room) if ok], "_c long")
    got = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("_c")).drop("_c").toArrow()
    ids, at = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)
    toxic = np.zeros(len(ids), int)
    np.maximum.at(toxic, at, got.column("toxic").to_numpy())
    lists = [got.column(c).combine_chunks() for c in ("terms", "counts")]
    flat = [np.asarray(x.flatten()) for x in lists]
    row = np.repeat(at, np.asarray(pc.list_value_length(lists[0])))
    order = np.lexsort((flat[0], row))
    row, term, count = row[order], flat[0][order].view(np.uint64), flat[1][order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    count = np.add.reduceat(count, first) if len(first) else count
    model = index(ids, toxic, row[first], term[first], count, gain, k, soften, block)
    del got, lists, flat, row, order, term, count, new, first, at
    release()
    return model


def relevance(df: np.ndarray, a: np.ndarray, n0: int, n1: int, gain: float) -> np.ndarray:
    """The factor of a word that `a` of n1 toxic and df - a of n0 other examples have."""
    n, rate = n0 + n1, n1 / max(1, n0 + n1)

    def part(seen, due):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-300) / np.maximum(due, 1e-300)), 0.0)

    b = df - a
    g = 2 * (part(a, df * rate) + part(b, df * (1 - rate)) + part(n1 - a, (n - df) * rate) + part(n0 - b, (n - df) * (1 - rate)))
    # few examples can tell little: the scale is at most a fifth of their labels' entropy
    told = -2 * (n1 * np.log(rate) + n0 * np.log(1 - rate)) if n0 and n1 else 0.0
    scale = min(gain, told / 5) if told else gain
    g = np.maximum(g, 0.0)
    return np.maximum((g / (g + scale)) ** 2, 1e-3)


def index(ids, toxic, row, term, count, gain=GAIN, k=NEIGHBOURS, soften=SOFTEN, block=BLOCK) -> dict:
    """The model: builtins and arrays only. row, term, count: the examples' words, sorted."""
    n = len(ids)
    vocab, col = np.unique(term, return_inverse=True)
    df = np.bincount(col, minlength=len(vocab))
    a = np.bincount(col, toxic[row] if n else None, minlength=len(vocab))
    n1 = int(toxic.sum())
    scale = (np.log((1 + n) / (1 + df)) + 1) * relevance(df, a, n - n1, n1, gain)
    w = (1 + np.log(count)) * scale[col] if n else np.zeros(0)
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    w = w / norm[row]
    # like examples become neighbours: by strongest word, then by the next
    order = np.lexsort((-w, row))
    begin = np.searchsorted(row[order], np.arange(n))
    last = np.searchsorted(row[order], np.arange(n), "right")
    top = [np.where(begin + j < last, col[order][np.minimum(begin + j, max(len(row) - 1, 0))], -1) if len(row) else np.zeros(n) for j in range(3)]
    place = np.lexsort((ids, top[2], top[1], top[0])) if n else np.zeros(0, np.int64)
    rank = np.empty(n, np.int64)
    rank[place] = np.arange(n)
    wide = -(-n // block) * block
    # the words of many examples as dense columns, with the largest weight of each block
    many = np.flatnonzero(df * 16 >= n)
    dense = np.full(len(vocab), -1, np.int32)
    dense[many] = np.arange(len(many))
    full = np.zeros((len(many), wide))
    is_many = dense[col] >= 0
    full[dense[col[is_many]], rank[row[is_many]]] = w[is_many]
    few = np.flatnonzero(~is_many)
    few = few[np.lexsort((rank[row[few]], col[few]))]
    start = np.searchsorted(col[few], np.arange(len(vocab) + 1))
    m = {
        "vocab": vocab, "scale": scale, "dense": dense, "full": full, "bounds": full.reshape(len(many), -1, block).max(axis=2) if wide else np.zeros((len(many), 0)),
        "start": start, "post": rank[row[few]].astype(np.int32), "weight": w[few], "ids": ids[place], "toxic": toxic[place].astype(float),
        "rate": n1 / n if n else 0.0, "k": k, "soften": soften, "block": block, "knots": (np.zeros(1), np.zeros(1)),
    }
    if n:
        votes, at = np.empty(n), 0
        mine = np.argsort(rank[row], kind="stable")
        r, t, c = rank[row][mine], term[mine], count[mine]
        for at in range(0, n, BATCH):
            i, j = np.searchsorted(r, (at, at + BATCH))
            size = min(BATCH, n - at)
            votes[at : at + size] = vote(m, size, *nearest(m, size, r[i:j] - at, t[i:j], c[i:j], skip=at))
        m["knots"] = isotonic(votes, m["toxic"])
    return m


def nearest(m: dict, n: int, row: np.ndarray, term: np.ndarray, count: np.ndarray, skip: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the index, cosine) of the k nearest examples of n texts, best
    first in each row; cosines are over 0. skip: text i leaves out the example skip + i."""
    vocab, block, k = m["vocab"], m["block"], m["k"]
    wide = m["bounds"].shape[1] * block
    col = np.minimum(np.searchsorted(vocab, term), max(len(vocab) - 1, 0))
    known = np.flatnonzero(vocab[col] == term) if len(vocab) else np.zeros(0, np.int64)
    row, col = row[known], col[known]
    w = (1 + np.log(count[known])) * m["scale"][col] if len(known) else np.zeros(0)
    norm = np.sqrt(np.bincount(row, w * w, minlength=n))
    w = w / norm[row]
    ask = np.zeros((n, len(m["full"])))
    often = m["dense"][col] >= 0
    ask[row[often], m["dense"][col[often]]] = w[often]
    row, col, w = row[~often], col[~often], w[~often]
    if not wide:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    size = m["start"][col + 1] - m["start"][col]
    upto, score = np.cumsum(size), np.zeros(n * wide)
    # postings are summed a bounded number at a time, whatever the texts hold
    edges = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(POSTINGS, upto[-1], POSTINGS)) + 1, [len(size)]))) if len(size) else [0]
    for i, j in zip(edges[:-1], edges[1:]):
        one = size[i:j]
        at = np.repeat(m["start"][col[i:j]] - np.cumsum(one) + one, one) + np.arange(one.sum())
        place = np.repeat(row[i:j] * wide, one) + m["post"][at]
        first = int(row[i]) * wide
        last = (int(row[j - 1]) + 1) * wide
        score[first:last] += np.bincount(place - first, np.repeat(w[i:j], one) * m["weight"][at], minlength=last - first)
    score = score.reshape(n, wide)
    bound = ask @ m["bounds"] + score.reshape(n, -1, block).max(axis=2)
    rare, score = score, np.full((n, wide), -1.0)
    opened = np.zeros(bound.shape, bool)

    def open_blocks(which):
        opened[which] = True
        for b in np.flatnonzero(which.any(axis=0)):
            docs, to = np.flatnonzero(which[:, b]), slice(b * block, (b + 1) * block)
            score[docs, to] = rare[docs, to] + ask[docs] @ m["full"][:, to]
        if skip is not None:
            score[np.arange(n), np.arange(skip, skip + n)] = -1.0

    # the best blocks hold more than k examples, their own left out; then all that may beat the k-th
    first = min(bound.shape[1], -(-(k + 1) // block) + 1)
    best = np.zeros(bound.shape, bool)
    np.put_along_axis(best, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
    open_blocks(best)
    edge = np.partition(score, max(wide - k, 0), axis=1)[:, max(wide - k, 0)]
    open_blocks((bound >= np.maximum(edge, 0)[:, None] - 1e-9) & ~opened)
    score[:, len(m["ids"]) :] = -1.0
    edge = np.partition(score, max(wide - k, 0), axis=1)[:, max(wide - k, 0)]
    row, at = np.nonzero((score >= edge[:, None]) & (score > 0))
    cos = np.minimum(score[row, at], 1.0)
    order = np.lexsort((at, -cos, row))
    row, at, cos = row[order], at[order], cos[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], at[keep], cos[keep]


def vote(m: dict, n: int, row: np.ndarray, at: np.ndarray, cos: np.ndarray) -> np.ndarray:
    """Distance-weighted votes; the rate of all examples without a neighbour."""
    w = 1 / (1 - cos + m["soften"])
    total = np.bincount(row, w, minlength=n)
    toxic = np.bincount(row, w * m["toxic"][at], minlength=n)
    return np.where(total > 0, toxic / np.maximum(total, 1e-12), m["rate"])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the non-decreasing least-squares fit."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for xi, yi in zip(x[order], y[order]):
        pools.append([xi, xi, yi, 1.0])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    knots = [(e, p[2] / p[3]) for p in pools for e in ((p[0], p[1]) if p[0] < p[1] else (p[0],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def scores(m: dict, col):
    """Yield (first row, scores, evidence lists) by batches of a string column."""
    for a, n, row, term, count in term_counts(col, BATCH):
        row, at, cos = nearest(m, n, row, term, count)
        score = np.interp(vote(m, n, row, at, cos), *m["knots"])
        few = np.arange(len(row)) - np.searchsorted(row, row) < 3
        shown: list = [[] for _ in range(n)]
        for r, d, c, y in zip(row[few].tolist(), m["ids"][at[few]].tolist(), cos[few].tolist(), m["toxic"][at[few]].astype(int).tolist()):
            shown[r].append({"doc_id": d, "cosine": c, "toxic": y})
        yield a, score, shown


def score_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """A struct column (score, evidence) for the texts of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kinds = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])

    def run(texts: pa.Array) -> pa.Array:
        got = list(scores(shared.value, texts))
        score = np.concatenate([g[1] for g in got]) if got else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(score), pa.array([e for g in got for e in g[2]], pa.list_(kinds))], names=["score", "evidence"])

    return F.arrow_udf(run, OUT)(F.col(text_col))


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score, predicted, evidence."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), score_column(docs, model, text_col).alias("t"))
    return rows.select("doc_id", F.col("t.score").alias("score"), (F.col("t.score") >= 0.5).cast("int").alias("predicted"), F.col("t.evidence").alias("evidence"))


def without_toxic(docs: DataFrame, model: dict, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose score is below the limit."""
    return docs.where(score_column(docs, model, text_col)["score"] < limit)
