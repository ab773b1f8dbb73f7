"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes of a text: h = (h << 1) + gear[byte], kept to 16
bits, so it depends on the last 16 bytes only and all positions are computed at
once. A chunk ends at the smallest hash of each window of 2 * mean - 1 places, so that
two cuts are never further apart; boundaries follow the content, so insertions shift
nothing beyond a window. A chunk is taken with the 16 bytes before it. Of each `pick`
consecutive chunks the one with the smallest digest is posted, which follows the
content too. Posted chunks are grouped by digest; of a digest's occurrences in several
documents the first (by doc_id, then place) is the original. Runs of chunks that
repeat the same stretch of one original at one shift are then compared byte by byte
with it, the run and `reach` bytes on both sides; where a passage goes on at the end
of what was read, the run is read again with eight times the reach, until none does.
Every stretch of equal bytes with `least_words` words or more is reported.

Places that are a window from both ends of a passage are cut alike wherever it stands,
so a passage of 16 + (pick + 3) * (2 * mean - 1) bytes holds `pick` complete chunks, and
with them a posted one, for certain (202 bytes with the default), and a shorter one with
a high probability.

Defined results: null and empty texts have no chunks; passages that repeat only
inside one document are left alone; rows that repeat a doc_id or have none are
taken as one document, the one without an id as the last of all; spans are byte offsets of the UTF-8 text, end exclusive;
the original keeps its passage; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import marks, maybe, remove, saved, slices, split_off

MEAN, PICK, LEAST_WORDS, REACH, BITS = 16, 3, 50, 256, 24
#: Stands for the id of rows without one.
NO_ID = (1 << 63) - 1
CHUNKS = "digest long, doc_id long, start int, size int"


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The gear hash over the last 16 bytes at every place, by doubling."""
    h = (tc.random_u64(9, 256) >> np.uint64(48)).astype(np.uint16)[raw]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(raw: np.ndarray, at: np.ndarray, mean: int) -> np.ndarray:
    """Ends of chunks inside texts: the leftmost smallest hash of each window that
    lies in one text, 16 bytes or more into it, where no text before has a part."""
    wide = 2 * mean - 1
    if len(raw) < wide:
        return np.zeros(0, np.int64)
    least = (gear_hash(raw).astype(np.uint64) << np.uint64(32)) | np.arange(len(raw), dtype=np.uint64)
    have = 1
    while have < wide:
        step = min(have, wide - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    begins = np.arange(len(least))
    doc = np.searchsorted(at, begins, "right") - 1
    least = least[(begins >= at[doc] + 15) & (begins + wide <= at[doc + 1])]
    return np.unique((least & np.uint64(0xFFFFFFFF)).astype(np.int64)) + 1


def posted(h: np.ndarray, doc: np.ndarray, pick: int) -> np.ndarray:
    """True for the chunks that are the smallest, leftmost of equal ones, of any `pick`
    consecutive ones of their text; a text with fewer posts the smallest of all."""
    n, out = len(h), np.zeros(len(h), bool)
    width = np.bincount(doc)[doc] if n else h
    at = np.arange(n)
    for size in range(1, pick + 1):
        begin = np.flatnonzero((width == size) | (width > pick)) if size == pick else np.flatnonzero(width == size)
        begin = begin[begin + size <= n]
        begin = begin[doc[begin] == doc[begin + size - 1]]
        best = begin.copy()
        for j in range(1, size):
            best = np.where(h[begin + j] < h[best], at[begin + j], best)
        out[best] = True
    return out


def _chunks(mean, pick):
    def run(batches):
        for batch in batches:
            raw, off = tc.buffers(batch.column(1))
            for a, b in slices(np.diff(off).tolist(), 1 << 20):
                part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
                if not len(part):
                    continue
                ends = np.union1d(cuts(part, at, mean), at[1:])
                ends = ends[ends > 0]
                starts = np.concatenate(([0], ends[:-1]))
                doc = np.searchsorted(at, starts, "right") - 1
                starts = np.maximum(starts - 16, at[doc])
                h = tc.word_hashes(part, starts, ends, 11)
                take = posted(h, doc, pick) & (ends - starts >= 16)
                h, doc, starts, ends = h[take], doc[take], starts[take], ends[take]
                # in a text that goes on repeating itself, the first of equal posts
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                h, doc, starts, ends = h[new].view(np.int64), doc[new], starts[new], ends[new]
                ids = batch.column(0).slice(a, b - a).cast(pa.int64())
                yield pa.record_batch([pa.array(h), ids.take(pa.array(doc)), pa.array((starts - at[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))], names=["digest", "doc_id", "start", "size"])

    return run


def equal_parts(x: np.ndarray, y: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Maximal stretches where x and y agree that meet the places lo:hi."""
    same = np.zeros(len(x) + 2, np.int8)
    same[1:-1] = x == y
    step = np.diff(same)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return [(b, e) for b, e in zip(begin.tolist(), end.tolist()) if e > lo and b < hi]


def _grow(reach: int, least_words: int):
    """Both sides of a run (bytes before it, its own, bytes after) -> the passages that
    are equal on both, by place against the run's start; open: one may go on."""

    def run(batches):
        for batch in batches:
            out = []
            for run_id, b1, m1, a1, b2, m2, a2 in zip(*(batch.column(c).to_pylist() for c in range(7))):
                back, size = min(len(b1), len(b2)), min(len(m1), len(m2))
                left, right = b1[len(b1) - back :] + m1 + a1, b2[len(b2) - back :] + m2 + a2
                n = min(len(left), len(right))
                x, y = np.frombuffer(left, np.uint8, n), np.frombuffer(right, np.uint8, n)
                parts = equal_parts(x, y, back, back + size)
                far = any((b == 0 and back == reach) or (e == n and min(len(a1), len(a2)) == reach) for b, e in parts)
                if far:
                    out.append((run_id, 0, 0, 0, True))
                    continue
                for b, e in parts:
                    words = len(left[b:e].split())
                    if words >= least_words:
                        out.append((run_id, b - back, e - back, words, False))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["run", "from", "to", "n_words", "open"])

    return run


def _runs(chunks: DataFrame, mean: int, pick: int, bits: int) -> DataFrame:
    """run, doc_id, s1, e1 and first_doc_id, s2, e2: stretches that repeat an original."""
    first = F.min(F.struct("doc_id", "start")).alias("o")
    shared = chunks.groupBy("digest").agg(first, F.max("doc_id").alias("last")).where("last <> o.doc_id").select("digest", F.col("o.doc_id").alias("first_doc_id"), F.col("o.start").alias("first_start"))
    shared = saved(shared, "shared")
    seen, hit = maybe(chunks, F.col("digest"), marks(shared, "digest", bits), bits)
    repeats = seen.where(hit).drop("_lode_maybe").join(shared, "digest").where("doc_id <> first_doc_id").select("doc_id", "first_doc_id", "start", "first_start", "size")
    # chunks of one document that repeat one original at one shift, joined where posted ones may be neighbours
    shift = F.col("start") - F.col("first_start")
    order = Window.partitionBy("doc_id", "first_doc_id", "shift").orderBy("start")
    new = F.when(F.col("start") - F.lag(F.col("start") + F.col("size")).over(order) <= pick * 2 * mean, 0).otherwise(1)
    groups = repeats.withColumn("shift", shift).withColumn("new", new).withColumn("k", F.sum("new").over(order))
    runs = groups.groupBy("doc_id", "first_doc_id", "shift", "k").agg(F.min("start").alias("s1"), F.max(F.col("start") + F.col("size")).alias("e1"))
    runs = runs.select("doc_id", "first_doc_id", "s1", "e1", (F.col("s1") - F.col("shift")).alias("s2"), (F.col("e1") - F.col("shift")).alias("e2"))
    return saved(runs.withColumn("run", F.xxhash64("doc_id", "first_doc_id", "s1", "s2")), "runs", (shared,))


def _compared(narrow: DataFrame, runs: DataFrame, reach: int, least_words: int) -> DataFrame:
    """run, from, to, n_words, open for the runs, read with `reach` bytes on both sides."""
    mine = runs.select("doc_id", F.col("s1").alias("s"), F.col("e1").alias("e"))
    theirs = runs.select(F.col("first_doc_id").alias("doc_id"), F.col("s2").alias("s"), F.col("e2").alias("e"))
    asked = saved(mine.union(theirs).distinct(), "asked")  # an original's stretch is read once for all its runs
    raw, s, e = F.col("text").cast("binary"), F.col("s"), F.col("e")
    cut = lambda at, n: F.substring(raw, at + 1, n)
    low = F.greatest(s - reach, F.lit(0))
    texts, _ = split_off(narrow.where("text is not null"), F.col("doc_id"), asked.select("doc_id").distinct(), "doc_id")
    around = texts.join(asked, "doc_id").select("doc_id", "s", "e", cut(low, s - low).alias("b"), cut(s, e - s).alias("m"), cut(e, F.lit(reach)).alias("a"))
    around = saved(around, "around", (asked,))
    one = around.select(F.col("doc_id"), F.col("s").alias("s1"), F.col("e").alias("e1"), F.col("b").alias("b1"), F.col("m").alias("m1"), F.col("a").alias("a1"))
    two = around.select(F.col("doc_id").alias("first_doc_id"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("b").alias("b2"), F.col("m").alias("m2"), F.col("a").alias("a2"))
    pairs = runs.join(one, ["doc_id", "s1", "e1"]).join(two, ["first_doc_id", "s2", "e2"])
    grown = pairs.select("run", "b1", "m1", "a1", "b2", "m2", "a2").mapInArrow(_grow(reach, least_words), "run long, from long, to long, n_words long, open boolean")
    return saved(grown, "grown", (around,))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, pick: int = PICK, least_words: int = LEAST_WORDS, reach: int = REACH, bits: int = BITS) -> DataFrame:
    """One row per passage that repeats another document's: doc_id, start, end
    (bytes), n_words, first_doc_id, first_start."""
    narrow = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    chunks = saved(narrow.mapInArrow(_chunks(mean, pick), CHUNKS), "chunks")
    runs = _runs(chunks, mean, pick, bits)
    remove(chunks)
    out, todo = None, runs
    while True:
        grown = _compared(narrow, todo, reach, least_words)
        # several runs may grow into the same passage
        found = todo.join(grown.where("not open"), "run").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("s1") + F.col("from")).alias("start"), (F.col("s1") + F.col("to")).alias("end"), "n_words", "first_doc_id", (F.col("s2") + F.col("from")).alias("first_start"))
        out = found if out is None else out.unionByName(found)
        more = grown.where("open").select("run").distinct()
        if not more.head(1):
            return out.distinct()
        todo, reach = saved(todo.join(more, "run"), "runs"), 8 * reach


def without_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated passages cut out of their texts."""
    spans = passages.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_set(F.struct(F.col("start").alias("s"), F.col("end").alias("e"))).alias("_spans"))
    joined = docs.join(spans, F.col(id_col).cast("long") == F.col("_d"), "left")

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, cut_at in zip(texts, spans):
            if text is not None and cut_at is not None:
                raw, kept, at = text.encode(), [], 0
                for s, e in sorted((x["s"], x["e"]) for x in cut_at):
                    kept.append(raw[at : max(at, s)])
                    at = max(at, e)
                text = b"".join([*kept, raw[at:]]).decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out)

    cleaned = F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(F.pandas_udf(run, "string")(F.col(text_col), F.col("_spans")))
    return joined.withColumn(text_col, cleaned).drop("_d", "_spans")
