"""Secret scans through a trigram inverted index.

For each rule's regex a Boolean trigram query is derived from its parse tree: a
text that matches must hold these trigrams. Documents are indexed in segments of
bounded size: a segment's postings list, for every trigram that some query asks
for, the documents that hold it; AND intersects and OR unites postings, and the
documents left over are verified with the regex itself. Rules without mandatory
trigrams scan every document of the segment. Segments live inside a task, so
nothing is shuffled and no posting outgrows its segment.

Matching is on UTF-8 bytes; all rules are ASCII, so spans are the same as on
characters, and offsets are given in code points, end exclusive.

Defined results: a null text is empty and has no spans; repeated rows and ids are
rows of their own; an empty table gives an empty result; extra columns are kept
by scan_column() and ignored by scan().
"""

from __future__ import annotations

import itertools
import re
from re import _constants as rc
from re import _parser as rp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import slices


class Rule(NamedTuple):
    kind: str
    regex: str
    any_case: bool = False
    group: int = 0
    least: int = 0


#: The three base rules, in the order of their kinds (fixed patterns).
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", False, 0, 32),
)
#: Further rules, after the base ones (fixed patterns of public key formats).
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", False, 0, 36),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]+", False, 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", False, 0, 20),
)
RULES = BASE + MORE
MOST_STRINGS = 64


# -- Boolean trigram queries: True (no condition), bytes (one trigram), ("and"|"or", parts)
def _all(parts):
    flat = []
    for p in parts:
        if p is not True:
            flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings) -> object:
    """What holds if one of the strings occurs."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(regex: str, any_case: bool = False):
    """The Boolean query that each text matching the regex satisfies, over
    ASCII-lower-cased trigrams."""

    def walk(items):
        """(strings it matches exactly or None, query)"""
        run, found = {b""}, []

        def flush():
            nonlocal run
            found.append(_needs(run))
            run = {b""}

        whole = True
        for op, arg in items:
            exact, query = one(op, arg)
            if exact is not None and len(exact) * len(run) <= MOST_STRINGS:
                run = {a + b for a in run for b in exact}
            else:
                flush()
                whole = False
                if exact is not None:
                    run = set(exact)
                else:
                    found.append(query)
        if whole:
            return run, _needs(run)
        flush()
        return None, _all(found)

    def one(op, arg):
        if op is rc.LITERAL:
            s = chr(arg).lower().encode()
            return {s}, _needs({s})
        if op is rc.IN:
            chars = set()
            for kind, x in arg:
                if kind is rc.LITERAL:
                    chars.add(x)
                elif kind is rc.RANGE:
                    chars.update(range(x[0], min(x[1], x[0] + 99) + 1))
                else:
                    return None, True
            low = {chr(x).lower().encode() for x in chars}
            return (low if len(low) <= 8 else None), True
        if op is rc.SUBPATTERN:
            return walk(arg[3])
        if op is rc.BRANCH:
            parts = [walk(x) for x in arg[1]]
            sets = [p[0] for p in parts]
            if all(s is not None for s in sets) and sum(map(len, sets)) <= MOST_STRINGS:
                joined = set().union(*sets)
                return joined, _needs(joined)
            return None, _any([p[1] for p in parts])
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            exact, query = walk(inner)
            if exact is not None and high is not rc.MAXREPEAT and high <= 2:
                strings = {b"".join(t) for n in range(low, high + 1) for t in itertools.product(exact, repeat=n)}
                if len(strings) <= MOST_STRINGS:
                    return strings, _needs(strings)
            return None, query if low else True
        return (({b""}, True) if op is rc.AT else (None, True))

    return walk(rp.parse(regex))[1]


def trigrams_of(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Segment:
    """Postings of the wanted trigrams over the documents of one byte buffer."""

    def __init__(self, low: np.ndarray, off: np.ndarray, wanted: list[bytes], table: np.ndarray):
        self.n, self.lists = len(off) - 1, {t: np.zeros(0, np.int64) for t in wanted}
        if len(low) < 3:
            return
        code = (low[:-2].astype(np.uint32) << 16) | (low[1:-1].astype(np.uint32) << 8) | low[2:]
        number = table[code]
        at = np.flatnonzero(number)
        doc = np.searchsorted(off, at, "right") - 1
        inside = at + 3 <= off[doc + 1]
        at, doc = at[inside], doc[inside]
        pair = np.unique(number[at].astype(np.int64) * self.n + doc)
        cut = np.searchsorted(pair, np.arange(1, len(wanted) + 2) * self.n)
        for i, t in enumerate(wanted):
            self.lists[t] = pair[cut[i] : cut[i + 1]] - (i + 1) * self.n

    def find(self, query) -> np.ndarray:
        """Sorted documents that satisfy a query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.lists[query]
        out = None
        for part in query[1]:
            x = self.find(part)
            out = x if out is None else np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
            if query[0] == "and" and not len(out):
                break
        return out


def scanner(rules: tuple[Rule, ...] = RULES):
    """A function from an Arrow string column to, per row, its sorted spans
    (start, number of the rule, end) in code points."""
    rules = [Rule(*r) for r in rules]
    found = [trigram_query(r.regex, r.any_case) for r in rules]
    regexes = [re.compile(r.regex.encode(), re.IGNORECASE if r.any_case else 0) for r in rules]
    wanted = sorted(set().union(*map(trigrams_of, found)))
    table = np.zeros(1 << 24, np.uint8)
    for i, t in enumerate(wanted):
        table[(t[0] << 16) | (t[1] << 8) | t[2]] = i + 1
    if len(wanted) > 254:
        raise ValueError("too many trigrams for one index")
    lower = tc.lower_table()

    def scan(col) -> list[list[tuple[int, int, int]]]:
        raw, off = tc.buffers(col)
        spans = [[] for _ in range(len(off) - 1)]
        for a, b in slices(np.diff(off).tolist(), 1 << 20):
            part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
            data, segment = part.tobytes(), Segment(lower[part], at, wanted, table)
            for k, (rule, query, regex) in enumerate(zip(rules, found, regexes)):
                for d in segment.find(query).tolist():
                    lo, hi = int(at[d]), int(at[d + 1])
                    for m in regex.finditer(data, lo, hi):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            spans[a + d].append((m.start() - lo, k, m.end() - lo))
            for d in range(a, b):
                if spans[d]:
                    text = raw[off[d] : off[d + 1]]
                    lead = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                    spans[d] = sorted((int(lead[s]), k, int(lead[e])) for s, k, e in spans[d])
        return spans

    return scan


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, found array<struct<kind, start, end>> in
    order of start, then of the rules."""
    rules = tuple(tuple(r) for r in rules)
    kinds = [r[0] for r in rules]

    def run(batches):
        find = scanner(rules)
        for batch in batches:
            found = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in row] for row in find(batch.column(1))]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "found"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """scan()'s rows -> doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


