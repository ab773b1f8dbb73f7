"""Benchmark decontamination by spaced-seed hashing.

A mask such as 1101100101011 reads the marked word positions of a window and
ignores the others, so a hash survives substitutions at ignored places. Windows
of the benchmark and of the documents are hashed under a few fixed masks and
joined on the hash. A bitmap of the benchmark's hashes, of fixed size and
broadcast, thins the documents' hashes before the join; it has no false
negatives. Each hit gives a diagonal (document position - item position), and the
words on it are compared one by one around the hit: a run that scores +1 for an
equal word and -2 for another counts as an overlap if it is `least_words` long
(or the whole of a shorter item) with `share` of its words equal.

Words are maximal runs of letters and digits in lower case, so changes of case,
punctuation and spacing do not matter. Items of 5 to 12 words have shorter masks of
their own and are compared as a whole, `share` of their words equal; items of 3 and 4
words must occur unchanged; items of 1 and 2 words, which occur everywhere, match
the documents that consist of nothing else.

Defined results: null or empty texts and items match nothing, nor do items without an
id; an item that repeats under another id is reported under each, one that repeats
with its id once; rows that repeat a doc_id are compared each and the best overlap
with an item is reported, the first of equal ones; rows without an id are told apart by
their texts and have a null doc_id; empty tables give an empty result; extra columns are
ignored by overlaps() and kept by clean().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import row_key, saved, slices, split_off

#: Masks of weight 8 over 12 or 13 words (fixed values).
MASKS = ("110110101101", "1110010110011", "1011100101101", "110011101011")
#: Masks for items of 5 to 12 words (fixed values).
SHORT_MASKS = ("1111", "10111", "11011", "11101")
LEAST_WORDS, SHARE, BITS = 13, 0.8, 26
SEEDS = "key long, pos int, mask int, hash long"
FOUND = "key long, doc_id long, item_id long, words_equal long, words_long long, first_word long"


def _hashed(col, seed: int = 3):
    """Yield (first row, word hashes, row offsets) by slices of a column."""
    raw, off = tc.buffers(pc.utf8_lower(col))
    table = tc.alnum_table()
    for a, b in slices(np.diff(off).tolist(), 1 << 20):
        part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        if len(part):
            s, e, rows = tc.words(part, at, table)
            yield a, tc.word_hashes(part, s, e, seed), rows
        else:
            yield a, np.zeros(0, np.uint64), np.zeros(b - a + 1, np.int64)


def _spaced(h: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hashes of all windows of the whole buffer under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    times = tc.random_u64(100, len(mask)) | np.uint64(1)
    out = np.full(n, number, np.uint64)
    for j, c in enumerate(mask):
        if c == "1":
            out += h[j : j + n] * times[j]
    return tc.mix(out)


def _row_of(rows: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def _family(n: int, masks: tuple) -> list[tuple[int, str]]:
    """(number, mask) of the masks for an item of n words; 100 + n: whole of so many words."""
    if n >= max(map(len, masks)):
        return list(enumerate(masks))
    if n >= 5:
        return [(50 + k, m) for k, m in enumerate(SHORT_MASKS)]
    return [(100 + n, "1" * n)]


def _item_seeds(masks):
    """Seeds of the benchmark: all windows, or the whole of a tiny item."""

    def run(batches):
        for batch in batches:
            for a, h, rows in _hashed(batch.column(1)):
                ids, out = batch.column(0).slice(a, len(rows) - 1).to_pylist(), []
                for i, (x, y) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                    for k, m in _family(y - x, masks) if y > x else ():
                        v = _spaced(h[x:y], m, k)
                        out.append((np.full(len(v), ids[i]), np.arange(len(v)), np.full(len(v), k), v.view(np.int64)))
                if out:
                    c = [np.concatenate(z) for z in zip(*out)]
                    yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1].astype(np.int32)), pa.array(c[2].astype(np.int32)), pa.array(c[3])], names=["key", "pos", "mask", "hash"])

    return run


def _probe(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """True where both bits of a hash are set."""
    one = (h >> np.uint64(64 - bits)).astype(np.int64)
    ok = np.flatnonzero((bitmap[one >> 3] >> (one & 7).astype(np.uint8)) & 1)
    two = (h[ok] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return ok[((bitmap[two >> 3] >> (two & 7).astype(np.uint8)) & 1).astype(bool)]


def _doc_seeds(bitmap, seeds, bits):
    """key, text -> the windows whose hash the benchmark may have."""

    def run(batches):
        for batch in batches:
            for a, h, rows in _hashed(batch.column(1)):
                ids = batch.column(0).slice(a, len(rows) - 1)
                row = _row_of(rows)
                for k, m in seeds:
                    v = _spaced(h, m, k)
                    at = _probe(bitmap.value, v, bits) if len(v) else np.zeros(0, np.int64)
                    at = at[row[at] == row[at + len(m) - 1]]
                    if k in (101, 102):  # nothing else in the document
                        at = at[np.diff(rows)[row[at]] == k - 100]
                    if len(at):
                        r = row[at]
                        yield pa.record_batch([ids.take(pa.array(r)), pa.array((at - rows[r]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(v[at].view(np.int64))], names=["key", "pos", "mask", "hash"])

    return run


def best_run(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the run with the best sum of +1 and -2."""
    s = np.concatenate(([0], np.cumsum(np.where(equal, 1, -2))))
    low = np.minimum.accumulate(s)
    end = int(np.argmax(s - low))
    return int(np.argmax(s[: end + 1] == low[end])), end


def overlap(equal: np.ndarray, size: int, least: int, share: float) -> tuple[int, int] | None:
    """Start and end of the overlap on a diagonal of an item of `size` words, if there is one."""
    if size < least:
        return (0, size) if len(equal) == size and equal.sum() >= share * size else None
    s, e = best_run(equal)
    return (s, e) if e - s >= least and equal[s:e].sum() >= share * (e - s) else None


def _verify(least, share):
    """key, doc_id, text, items (item_id, diags, words) -> FOUND, row by row."""

    def run(batches):
        for batch in batches:
            keys, ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()
            out = []
            for a, h, at in _hashed(batch.column(2)):
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()), a):
                    for item in lists[i] or ():
                        words, best = np.array(item["words"], np.int64).view(np.uint64), None
                        if len(words) < 3 and y - x != len(words):
                            continue
                        for diag in item["diags"]:
                            lo, hi = max(0, -diag), min(len(words), y - x - diag)
                            got = overlap(h[x + diag + lo : x + diag + hi] == words[lo:hi], len(words), least, share) if hi > lo else None
                            if got:
                                s, e = got
                                same = int((h[x + diag + lo + s : x + diag + lo + e] == words[lo + s : lo + e]).sum())
                                best = max(best or (0, 0, -(1 << 60)), (same, e - s, -(diag + lo + s)))
                        if best:
                            out.append((keys[i], ids[i], item["item_id"], *best[:2], -best[2]))
            cols = list(zip(*out)) or [()] * 6
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])

    return run


def _item_words(batches):
    for batch in batches:
        for a, h, rows in _hashed(batch.column(1)):
            parts = [h[x:y].view(np.int64) for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())]
            yield pa.record_batch([batch.column(0).slice(a, len(parts)).cast(pa.int64()), tc.list_array(parts, pa.int64())], names=["item_id", "words"])


def _bitmap(tests: DataFrame, bits: int) -> np.ndarray:
    """Two bits for each hash: at most 2^(bits - 6) words of 64 bits reach the driver,
    whatever the benchmark's size."""
    h = F.col("hash")
    slot = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND((1 << bits) - 1)))
    words = tests.select(slot.alias("b")).groupBy(F.shiftright("b", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), "<i8")
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return out.view(np.uint8)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks=MASKS, least_words: int = LEAST_WORDS, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, item_id,
    words_equal, words_long, first_word (place of the overlap in the document)."""
    spark, masks = docs.sparkSession, tuple(masks)
    narrow = docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    tests = saved(items.mapInArrow(_item_seeds(masks), SEEDS).withColumnsRenamed({"key": "item_id", "pos": "off"}), "test-seeds")
    used = {r[0] for r in tests.select("mask").distinct().collect()}
    seeds = [(k, m) for n in (1, 2, 3, 4, 5, max(map(len, masks))) for k, m in _family(n, masks) if k in used]
    shared = spark.sparkContext.broadcast(_bitmap(tests, bits))
    hits = narrow.select("key", "text").mapInArrow(_doc_seeds(shared, seeds, bits), SEEDS)
    cands = hits.join(tests, ["mask", "hash"]).select("key", "item_id", (F.col("pos") - F.col("off")).alias("diag")).distinct()
    cands = saved(cands, "candidates", (tests,))
    chosen, _ = split_off(narrow, F.col("key"), cands.select("key").distinct(), "key")
    words = items.mapInArrow(_item_words, "item_id long, words array<long>")
    # one row of candidates for each key, at most as long as its text; rows that share a
    # key (or have no text apart) meet it in a join that can be split
    lists = cands.groupBy("key", "item_id").agg(F.sort_array(F.collect_list("diag")).alias("diags")).join(words, "item_id")
    lists = lists.groupBy("key").agg(F.collect_list(F.struct("item_id", "diags", "words")).alias("items"))
    rows = chosen.join(lists, "key").select("key", "doc_id", "text", "items").mapInArrow(_verify(least_words, share), FOUND)
    best = F.max(F.struct("words_equal", "words_long", (-F.col("first_word")).alias("at"))).alias("b")
    return rows.groupBy("key", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.words_equal", "b.words_long", (-F.col("b.at")).alias("first_word"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that overlap an item; rows that share an id are judged each."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    found = overlaps(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    bad = saved(found.select(F.col("doc_id").alias("_bad")).distinct(), "leaks")
    return split_off(docs, key, bad, "_bad")[1]
