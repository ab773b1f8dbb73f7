"""Near-duplicate detection: a signature-coordinate inverted join over MinHash.

1. Every document becomes its set of distinct word shingles (64-bit hashes), the
   set's digest, and a signature of `coords` minimum hashes. Documents with equal
   digests form one class, so exact copies never meet each other again.
2. Classes are posted under each (coordinate, value) pair. Postings of a single
   class drop out (skip): a class with fewer than `least` shared postings has no
   partner above the match threshold. Of the t others a class keeps its
   t - least + 1 rarest as prefix: two classes with `least` common coordinates
   share a posting of both prefixes.
3. Posting lists are merged in rounds. A round takes as pivot of each list the member
   whose postings are the longest together, which is the text that a group of copies
   derives from, and pairs the others with it unless both have one label already; the
   pairs' common coordinates are counted, and only those that reach the match threshold
   have their full sets fetched and compared. Links give labels, a list with one label
   is done, and pivots leave their list. What remains
   after `rounds` is counted block by block, members outside a list's largest label
   against all members, two members only in the first list that both are in; the sets of
   those that reach the threshold with someone of another label are then compared in
   the same blocks. No step emits the pairs of
   a group, and no pair above the threshold is passed over.

With 48 coordinates and 22 common ones, a pair at the similarity 0.75 is missed
with a probability of about 1e-5, one at 0.8 with less than 1e-7. Coordinates have
64 bits, so unrelated documents share none, however many there are.

A bitmap of fixed size thins what is shuffled (single postings, texts whose sets
nobody asks for); once it is full it thins nothing and the results are the same.

Defined results: a null or blank text has no shingles, links with nothing and is
its own component; rows that repeat an id share it; null ids take the component's
smallest id, null if it has none; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import marks, maybe, remove, row_key, saved, slices, split_off
from .components import components

COORDS, LEAST, ROUNDS, BLOCK, BITS = 48, 22, 2, 1024, 24
#: Set members that one side of a block may hold.
CELLS = 1 << 20
FEATURES = "key long, doc_id long, n long, dig binary, sig array<long>"


def shingle_sets(col: pa.Array, k: int):
    """Yield (first row, list of sorted distinct shingle hashes) by slices of a column."""
    raw, off = tc.buffers(col)
    is_word, low = tc.space_table(), tc.lower_table()
    for a, b in slices(np.diff(off).tolist(), 1 << 20):
        part, at = low[raw[off[a] : off[b]]], off[a : b + 1] - off[a]
        if len(part):
            s, e, rows = tc.words(part, at, is_word)
            yield a, tc.shingles(tc.word_hashes(part, s, e), rows, k)
        else:
            yield a, [np.zeros(0, np.uint64)] * (b - a)


def digest(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def signatures(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Rows of minimum hashes, for sets that are not empty. A value tells its
    coordinate too, and minima are mixed again, since those of large sets are small."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(x) for x in sets[:-1]])
    flip, times, salt = tc.random_u64(5, coords), tc.random_u64(6, coords) | np.uint64(1), tc.random_u64(8, coords)
    out, tmp = np.empty((len(sets), coords), np.int64), np.empty_like(flat)
    for j in range(coords):
        np.bitwise_xor(flat, flip[j], out=tmp)
        tmp *= times[j]
        out[:, j] = tc.mix(np.minimum.reduceat(tmp, first) + salt[j]).view(np.int64)
    return out


def _features(k: int, coords: int):
    """key, doc_id, text -> FEATURES"""

    def run(batches):
        for batch in batches:
            for a, sets in shingle_sets(batch.column(2), k):
                full = [x for x in sets if len(x)]
                sig = iter(signatures(full, coords)) if full else iter(())
                sigs = [next(sig) if len(x) else None for x in sets]
                ids = [batch.column(c).slice(a, len(sets)) for c in (0, 1)]
                yield pa.record_batch([*ids, pa.array([len(x) for x in sets], pa.int64()), pa.array([digest(x) for x in sets], pa.binary()), pa.array(sigs, pa.list_(pa.int64()))], names=["key", "doc_id", "n", "dig", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), k):
                full = [x for x in sets if len(x)]
                if full:
                    yield pa.record_batch([pa.array([digest(x) for x in full], pa.binary()), tc.list_array([x.view(np.int64) for x in full], pa.int64())], names=["dig", "items"])

    return run


class _Block:
    """One block pair of a posting list: rows that ask (side 0) and all rows (side 1)."""

    def __init__(self, table: pa.Table):
        self.tok = table.column("tok")[0].as_py() if table.num_rows else 0
        side = np.array(table.column("side").to_pylist(), int)
        self.ask, self.data = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1)
        self.dig, self.lab = table.column("dig").to_pylist(), table.column("lab").to_pylist()
        self.place = np.argsort(np.argsort(np.array(self.dig, object).astype("S16")))
        self.other = np.array(table.column("other").to_pylist(), bool)
        lists = table.column("toks").combine_chunks()
        size, none = np.diff(np.asarray(lists.offsets)), np.iinfo(np.int64).max
        self.toks = np.full((len(size), max(size, default=1)), none)
        self.toks[np.arange(self.toks.shape[1]) < size[:, None]] = np.asarray(lists.flatten())

    def partners(self, i: int, size: np.ndarray, num: int, den: int) -> np.ndarray:
        """Rows that i is compared with here: their sizes allow a link, this list is the
        first that both are in, and of two that ask each other one asks."""
        near = self.data[den * np.minimum(size[self.data], size[i]) >= num * np.maximum(size[self.data], size[i])]
        near = near[~self.other[near] | (self.place[near] > self.place[i])]
        both = self.toks[near]
        both = np.where(np.isin(both, self.toks[i]), both, np.iinfo(np.int64).max)
        return near[both.min(axis=1) == self.tok] if len(near) else near


def _count_block(least: int, num: int, den: int):
    """The members of one block pair that reach the threshold with a member of another label."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        sig, size = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(table.num_rows, -1), table.column("n").to_numpy()
        _, lab = np.unique(np.array(block.lab, object).astype("S16"), return_inverse=True)
        hit = np.zeros(table.num_rows, bool)
        for i in block.ask:
            near = block.partners(i, size, num, den)
            near = near[lab[near] != lab[i]]
            near = near[(sig[near] == sig[i]).sum(axis=1) >= least]
            hit[near] = True
            hit[i] = len(near) > 0
        return table.filter(pa.array(hit)).drop_columns(["sig", "n"])

    return run


def _link_block(num: int, den: int):
    """Confirm links between the two sides of one block pair of a posting list."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        col = table.column("items").combine_chunks()
        off, flat = np.asarray(col.offsets), np.asarray(col.values).view(np.uint64)
        items, size = [flat[off[i] : off[i + 1]] for i in range(len(off) - 1)], np.diff(off)
        root = {x: x for x in block.lab}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out = []
        for i in block.ask:
            for j in block.partners(i, size, num, den).tolist():
                a, b = find(block.lab[i]), find(block.lab[j])
                if a == b:
                    continue
                both = len(np.intersect1d(items[i], items[j], assume_unique=True))
                if den * both >= num * (size[i] + size[j] - both):
                    root[a] = b
                    out.append((block.dig[i], block.dig[j]))
        return pa.table({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, coords: int = COORDS, least: int = LEAST, rounds: int = ROUNDS, block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Documents
    link if 100 * |A and B| >= percent * |A or B| for their shingle sets."""
    spark = docs.sparkSession
    narrow = docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = saved(narrow.mapInArrow(_features(k, coords), FEATURES), "features")
    classes = rows.where("n > 0").groupBy("dig").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("copies"), F.min("key").alias("rep"), F.min("doc_id").alias("least"))
    classes = saved(classes, "classes")
    posted = classes.select("dig", "n", F.explode("sig").alias("tok"))
    shared = saved(posted.select("tok").groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    seen, hit = maybe(posted, F.col("tok"), marks(shared, "tok", bits), bits)
    lists = seen.where(hit).select("dig", "n", "tok").join(shared, "tok").groupBy("dig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("t")).where(F.size("t") >= least)
    weight = F.aggregate("t", F.lit(0).cast("long"), lambda total, x: total + x["df"])
    lists = lists.select("dig", "n", weight.alias("weight"), F.explode(F.slice("t", F.lit(1), F.size("t") - least + 1)).alias("t")).select("dig", "n", "weight", F.col("t.tok").alias("tok"))
    lists = saved(lists, "lists", (shared,))
    labels = None
    if lists.head(1):
        need = classes.join(lists.select("dig").distinct(), "dig", "left_semi").select("dig", "sig", "n", "rep")
        need = saved(need, "need")
        chosen, _ = split_off(narrow.select("key", "text"), F.col("key"), need.select("rep").distinct(), "rep")
        sets = chosen.select("text").mapInArrow(_sets(k), "dig binary, items array<long>")
        sets = saved(sets.join(need.select("dig"), "dig", "left_semi").dropDuplicates(["dig"]), "sets")
        labels = _merge(spark, lists, need, sets, least, rounds, percent, block)
        remove(need), remove(sets)
    remove(lists)
    if labels is None:
        labels = spark.createDataFrame([], "node binary, label binary")
    mine = classes.select("dig", "copies", "least").join(labels, F.col("dig") == F.col("node"), "left")
    mine = saved(mine.where("copies > 1 or label is not null").select("dig", F.coalesce("label", "dig").alias("label"), "least"), "grouped", (classes, labels))
    best = mine.groupBy("label").agg(F.min("least").alias("least"))
    ids = saved(mine.select("dig", "label").join(best, "label").select(F.col("dig").alias("node"), F.col("least"), F.lit(True).alias("found")), "class-ids", (mine,))
    out = rows.select("doc_id", "n", "dig").join(ids, F.col("dig") == F.col("node"), "left")
    comp = F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest
    id, or one of its rows if it repeats with the same text."""
    key = row_key(docs, id_col, text_col)
    rows = saved(near_groups(docs.select(key.alias("doc_id"), docs[text_col].alias("text")), **options), "near")
    gone = rows.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    again = rows.where("kept").groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    again = saved(again, "again")
    _, out = split_off(docs, key, gone, "_gone")
    if not again.head(1):
        return out
    twice, once = split_off(out, row_key(out, id_col, text_col), again, "_again")
    return twice.dropDuplicates([id_col, text_col]).unionByName(once)


def _merge(spark, lists, need, sets, least, rounds, percent, block) -> DataFrame | None:
    """Labels of the classes that have links, from the posting lists."""
    links, labels, here = [], None, saved(lists.withColumn("lab", F.col("dig")), "open")
    for _ in range(rounds):
        if not here.head(1):
            break
        pivots = here.groupBy("tok").agg(F.max(F.struct("weight", F.col("dig").alias("p"), F.col("lab").alias("pl"))).alias("x")).select("tok", "x.p", "x.pl")
        pivots = saved(pivots, "pivots")
        pairs = here.join(pivots, "tok").where("lab <> pl").select(F.col("dig").alias("a"), F.col("p").alias("b")).distinct()
        links.append(saved(_linked(_counted(pairs, need, least, percent), sets, percent), "found"))
        old, labels = labels, _shortcuts(_union(spark, links))
        here, last = _open(here.join(pivots, "tok").where("dig <> p").select("tok", "dig", "n", "weight"), labels), here
        for x in (old, last, pivots):
            remove(x)
    if here.head(1):
        links.append(_block_round(here, need, sets, least, percent, block))
    out = components(_union(spark, links))
    for x in (here, labels, *links):
        remove(x)
    return out


def _union(spark, links: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "a binary, b binary")
    for x in links:
        out = out.union(x)
    return out


def _shortcuts(links: DataFrame) -> DataFrame:
    """(node, label) with equal labels inside a component only: the smallest class
    that a node is linked with as `a`, and that one's own. Enough to skip comparisons;
    components() has the last word."""
    up = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    over = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return saved(up.join(over, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the posting lists that hold more than one label."""
    here = saved(lists.join(labels, F.col("dig") == F.col("node"), "left").select("tok", "dig", "n", "weight", F.coalesce("label", "dig").alias("lab")), "labelled")
    mixed = saved(here.groupBy("tok").agg(F.min("lab").alias("lo"), F.max("lab").alias("hi")).where("lo <> hi").select("tok"), "mixed")
    return saved(here.join(mixed, "tok"), "open", (here, mixed))


def _counted(pairs, need, least, percent):
    """Pairs that share `least` coordinates and have sizes that allow a link."""
    one = need.select(F.col("dig").alias("a"), F.col("sig").alias("x"), F.col("n").alias("nx"))
    two = need.select(F.col("dig").alias("b"), F.col("sig").alias("y"), F.col("n").alias("ny"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    return both.where(F.size(F.array_intersect("x", "y")) >= least).select("a", "b")


def _linked(pairs, sets, percent):
    """Pairs of classes whose full sets link."""
    left = sets.select(F.col("dig").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("dig").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sure = pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both))
    return sure.select("a", "b")


def _block_round(here, need, sets, least, percent, block):
    parts = here.groupBy("tok", "lab").agg(F.count("*").alias("c"), F.max("n").alias("most"))
    of_list = parts.groupBy("tok").agg(F.sum("c").alias("all"), F.max(F.struct("c", "lab")).alias("top"), F.max("most").alias("most"))
    others, size = F.col("all") - F.col("top.c"), F.least(F.lit(block), F.greatest(F.lit(1), F.floor(F.lit(CELLS) / F.col("most"))))
    blocks = lambda rows: F.ceil(rows / size).cast("int")
    sizes = saved(of_list.select("tok", F.col("top.lab").alias("top"), blocks(others).alias("na"), blocks(F.col("all")).alias("nd")), "sizes")
    mine = here.groupBy("dig").agg(F.sort_array(F.collect_list("tok")).alias("toks")).join(need.select("dig", "sig"), "dig")
    side = here.join(sizes, "tok").join(saved(mine, "members"), "dig").withColumn("other", F.col("lab") != F.col("top"))
    place = lambda n: F.pmod(F.xxhash64("dig"), n).cast("int")
    at = lambda qa, qd, side: F.struct(qa.alias("qa"), qd.alias("qd"), F.lit(side).alias("side"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # each member once as one of its block's data, and once more as one that asks
    data = F.transform(span("na"), lambda q: at(q, place(F.col("nd")), 1))
    ask = F.transform(F.when(F.col("other"), span("nd")).otherwise(F.array().cast("array<int>")), lambda q: at(place(F.col("na")), q, 0))
    dealt = side.select("tok", F.explode(F.concat(data, ask)).alias("at"), "dig", "lab", "other", "toks", "sig", "n").select("tok", "at.*", "dig", "lab", "other", "toks", "sig", "n")
    kinds = "tok long, qa int, qd int, side int, dig binary, lab binary, other boolean, toks array<long>"
    alike = saved(dealt.groupBy("tok", "qa", "qd").applyInArrow(_count_block(least, percent, 100), kinds), "alike", (sizes,))
    out = alike.join(sets, "dig").groupBy("tok", "qa", "qd").applyInArrow(_link_block(percent, 100), "a binary, b binary")
    return saved(out.distinct(), "found", (alike,))
