"""Exact deduplication by composable polynomial fingerprints.

Texts are compared after deleting every space, tab, newline, vertical tab, form
feed and carriage return. A normalised text is cut into chunks; each chunk has
the fingerprint sum(byte_j * r^j) for two primes, and chunks combine by
H(AB) = H(A) + r^len(A) * H(B), so a document of any length is hashed chunk by
chunk. Texts whose fingerprints and lengths agree are then compared chunk by
chunk with one pivot of their group; those that differ form groups of their own.

Defined results: a null text is the empty text; all empty texts form one group.
Rows that repeat a doc_id are rows of their own in counts; `kept` is true for
each row that carries the keeper's id. A null id never wins against another. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import remove, saved, slices

#: Primes under 2^31 and bases of the two fingerprints (fixed values).
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 4096
PRINT_SCHEMA = "doc_id long, fp long, norm_len long, n_code long, sha string"
PIECE_SCHEMA = "doc_id long, fp long, norm_len long, piece int, bytes binary"


def combine(parts: list[tuple[int, int]], prime: int, base: int) -> int:
    """Fingerprint of a text from (fingerprint, length) of its chunks."""
    total, shift = 0, 1
    for value, size in parts:
        total = (total + shift * value) % prime
        shift = shift * pow(base, size, prime) % prime
    return total


def powers(prime: int, base: int, n: int) -> np.ndarray:
    out, x = np.empty(n, np.uint64), 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


def normalised(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = tc.space_table()[raw]
    upto = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=upto[1:])
    return raw[keep], upto[off]


def fingerprints(norm: np.ndarray, off: np.ndarray, tables: list[np.ndarray], chunk: int = CHUNK) -> np.ndarray:
    """One 62-bit fingerprint for each row of normalised bytes."""
    size = np.diff(off)
    n_chunks = -(-size // chunk)
    row = np.repeat(np.arange(len(size)), n_chunks)
    first = np.cumsum(n_chunks) - n_chunks
    start = off[:-1][row] + (np.arange(len(row)) - first[row]) * chunk
    length = np.minimum(start + chunk, off[1:][row]) - start
    out = np.zeros(len(size), np.uint64)
    if not len(row):
        return out
    place = np.arange(len(norm)) - np.repeat(start, length)
    for prime, base, table in zip(PRIMES, BASES, tables):
        part = np.add.reduceat(norm * table[place], start) % np.uint64(prime)
        whole = np.zeros(len(size), np.uint64)
        one = n_chunks == 1
        whole[one] = part[first[one]]
        for i in np.flatnonzero(n_chunks > 1):
            a, b = first[i], first[i] + n_chunks[i]
            whole[i] = combine(list(zip(part[a:b].tolist(), length[a:b].tolist())), prime, base)
        out = (out << np.uint64(31)) | whole
    return out


def _prints(batches):
    tables = [powers(p, b, CHUNK) for p, b in zip(PRIMES, BASES)]
    for batch in batches:
        ids = batch.column(0)
        raw, off = tc.buffers(batch.column(1))
        for a, b in slices(np.diff(off).tolist(), 2 << 20):
            part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            lead = np.zeros(len(part) + 1, np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=lead[1:])
            norm, to = normalised(part, at)
            view = memoryview(norm.tobytes())
            sha = [hashlib.sha256(view[x:y]).hexdigest() for x, y in zip(to[:-1].tolist(), to[1:].tolist())]
            yield pa.record_batch([ids.slice(a, b - a).cast(pa.int64()), pa.array(fingerprints(norm, to, tables).astype(np.int64)), pa.array(np.diff(to)), pa.array(np.diff(lead[at])), pa.array(sha)], names=["doc_id", "fp", "norm_len", "n_code", "sha"])


def _pieces(size: int):
    def run(batches):
        tables = [powers(p, b, CHUNK) for p, b in zip(PRIMES, BASES)]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, off = tc.buffers(batch.column(1))
            for a, b in slices(np.diff(off).tolist(), 2 << 20):
                norm, to = normalised(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                prints, data = fingerprints(norm, to, tables).astype(np.int64).tolist(), norm.tobytes()
                rows = [(ids[a + i], prints[i], y - x, j, data[x + j * size : min(y, x + j * size + size)]) for i, (x, y) in enumerate(zip(to[:-1].tolist(), to[1:].tolist())) for j in range(max(1, -(-(y - x) // size)))]
                cols = list(zip(*rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["doc_id", "fp", "norm_len", "piece", "bytes"])

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 16384, salt_rows: int = 64) -> DataFrame:
    """docs -> doc_id, fp, norm_len, cls, n_code, sha: rows with equal (fp,
    norm_len, cls) have equal normalised texts, confirmed chunk by chunk."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = saved(narrow.mapInArrow(_prints, PRINT_SCHEMA), "prints")
    key = ["fp", "norm_len"]
    groups = saved(prints.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("pivot")).where("n > 1"), "fp-groups")
    members = prints.join(groups, key).select("doc_id").distinct()
    chosen = narrow.join(members.withColumnRenamed("doc_id", "_m"), F.expr("doc_id <=> _m"), "left_semi")
    pieces = saved(chosen.mapInArrow(_pieces(piece_bytes), PIECE_SCHEMA).join(groups.select(*key, "n"), key), "pieces")
    classes, cls = None, 0
    left = groups.select(*key, "pivot")
    while True:
        salts = F.ceil(F.col("n") / salt_rows).cast("int")
        side = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
        lead = pieces.join(left, key).where(F.expr("doc_id <=> pivot")).select(*key, "piece", F.col("bytes").alias("lead"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        differ = saved(side.join(lead, [*key, "piece", "salt"]).where("bytes <> lead").select("doc_id", *key).distinct(), "differ")
        if not differ.head(1):
            break
        # texts that differ from the pivot: a class of their own, compared again
        cls += 1
        out = differ.withColumn("cls", F.lit(cls))
        classes = out if classes is None else out.unionByName(classes)
        left = saved(differ.groupBy(*key).agg(F.min("doc_id").alias("pivot")), "fp-left")
        ids = differ.select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("norm_len").alias("_n"))
        pieces = saved(pieces.join(ids, F.expr("doc_id <=> _d and fp = _f and norm_len = _n"), "left_semi"), "pieces")
    remove(pieces)
    if classes is None:
        return prints.withColumn("cls", F.lit(0))
    top = classes.groupBy("doc_id", *key).agg(F.max("cls").alias("cls")).select(F.col("doc_id").alias("_d"), F.col("fp").alias("_f"), F.col("norm_len").alias("_n"), "cls")
    return prints.join(top, F.expr("doc_id <=> _d and fp = _f and norm_len = _n"), "left").select("doc_id", *key, F.coalesce("cls", F.lit(0)).alias("cls"), "n_code", "sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Of
    equal texts the row with the most code points, then the smallest id, stays."""
    rows = exact_groups(docs, id_col, text_col)
    key = ["fp", "norm_len", "cls"]
    best = F.min(F.struct((-F.col("n_code")).alias("a"), F.col("doc_id").isNull().alias("b"), F.col("doc_id").alias("c")))
    groups = saved(rows.groupBy(*key).agg(F.count("*").alias("size"), best.alias("best")).where("size > 1").select(*key, "size", F.col("best.c").alias("keep")), "exact")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return rows.join(groups, key, "left").select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))
