"""Language identification by multilingual mixture inference.

Fitting: for a bounded sample of labelled documents (`per_lang` of each language,
by hash of the id) the byte 4-grams of words are counted by language; smoothed
log-likelihoods of 2^16 hashed n-grams are the model.

Prediction: every word of a text has a likelihood under each language, the
product over its n-grams. Expectation-maximisation estimates the proportions of
the languages in the document's words. The language set is chosen by penalised
likelihood: for growing sets of the strongest languages the proportions are
estimated again, and a larger set must raise the log-likelihood by more than
`penalty` * log(words) / 2 for each language added.

Whole texts are read; n-gram likelihoods exist for one step of bounded size at a
time, and of a long text only the words' likelihoods are kept.

Defined results: null, empty and letterless texts are `und` with score 0; a model
without any language answers `und`; languages tie in alphabetical order; repeated
rows are predicted each; an empty table gives an empty result; only the text is
read, so other columns cannot change a prediction.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as tc
from .common import saved, slices

BUCKETS = 1 << 16
PER_LANG, PENALTY, ALPHA, STEPS = 1500, 2.0, 0.1, 12
OUT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("mixture", T.StringType()), T.StructField("n_langs", T.IntegerType())])


def letters_table() -> np.ndarray:
    """True for ASCII letters and bytes of non-ASCII characters."""
    t = tc.alnum_table()
    t[0x30:0x3A] = False
    return t


def grams(raw: np.ndarray, s: np.ndarray, e: np.ndarray, is_letter: np.ndarray) -> np.ndarray:
    """Hashed 4-grams, one for each byte of each word: the byte before it (a
    space at the word's start), itself and the two that follow; beyond the end
    of the word everything is a space."""
    clean = np.full(len(raw) + 4, 32, np.uint8)
    body = clean[1 : len(raw) + 1]
    body[:] = np.where(is_letter[raw], raw, 32)
    size = e - s
    at = np.repeat(s - np.cumsum(size) + size, size) + np.arange(size.sum())
    first = np.zeros(len(at), bool)
    first[np.cumsum(size) - size] = True
    left = np.repeat(e, size) - at  # bytes of the word from here on
    b0 = np.where(first, 32, clean[at])
    b2 = np.where(left > 1, clean[at + 2], 32)
    b3 = np.where(left > 2, clean[at + 3], 32)
    code = b0.astype(np.uint32) | (clean[at + 1].astype(np.uint32) << 8) | (b2.astype(np.uint32) << 16) | (b3.astype(np.uint32) << 24)
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def read_words(col, most: int = 1 << 19):
    """Yield (first row, bytes, starts, ends, row offsets of words)."""
    raw, off = tc.buffers(pc.utf8_lower(col))
    table = letters_table()
    for a, b in slices(np.diff(off).tolist(), most):
        part, at = raw[off[a] : off[b]], off[a : b + 1] - off[a]
        if len(part):
            yield a, part, *tc.words(part, at, table)
        else:
            none = np.zeros(0, np.int64)
            yield a, part, none, none, np.zeros(b - a + 1, np.int64)


def word_logs(logp: np.ndarray, part: np.ndarray, s: np.ndarray, e: np.ndarray, is_letter: np.ndarray, most: int) -> np.ndarray:
    """Log-likelihoods, words x languages, from about `most` bytes at a time."""
    upto = np.cumsum(e - s)
    edges = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(most, upto[-1], most)), [len(s)])))
    out = np.empty((len(s), logp.shape[1]), np.float32)
    for i, j in zip(edges[:-1], edges[1:]):
        first = np.concatenate(([0], np.cumsum(e[i:j] - s[i:j])[:-1]))
        out[i:j] = np.add.reduceat(logp[grams(part, s[i:j], e[i:j], is_letter)], first, axis=0)
    return out


class Model(NamedTuple):
    langs: list
    logp: np.ndarray  # buckets x languages


def _counts(batches):
    """(lang, text) -> (lang, bucket, n), summed within a task."""
    table, total = letters_table(), {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, part, s, e, rows in read_words(batch.column(1)):
            if not len(s):
                continue
            g = grams(part, s, e, table)
            ends = np.concatenate(([0], np.cumsum(e - s)))[rows]
            for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                one = total.setdefault(langs[a + i], np.zeros(BUCKETS, np.int64))
                one += np.bincount(g[x:y], minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, alpha: float = ALPHA) -> Model:
    """Learn from rows with a language and a text; at most languages * 2^16
    counts reach the driver."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)), 11).alias("h"))
    # about twice as many rows as asked for pass a language's edge, all of a small one
    sizes = saved(rows.groupBy(F.col("lang").alias("_l")).agg((F.lit(float(1 << 53)) * F.least(F.lit(1.0), (2.0 * per_lang + 100) / F.count("*"))).alias("edge")), "languages")
    near = rows.join(sizes, F.expr("lang = _l and h < edge")).select("lang", "text", "h")
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_lang).select("lang", "text")
    counts = rows.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(langs)), alpha)
    for j, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        table[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32) if langs else table)


def em(like: np.ndarray, rows: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents whose words (likelihoods
    `like`, words x languages) lie at rows[i]:rows[i+1], none of them empty."""
    n = np.diff(rows)
    pi, at = start / start.sum(axis=1, keepdims=True), rows[:-1]
    for _ in range(steps):
        part = like * np.repeat(pi, n, axis=0)
        part /= part.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(part, at, axis=0) / n[:, None]
    total = np.log((like * np.repeat(pi, n, axis=0)).sum(axis=1))
    return pi, np.add.reduceat(total, at)


def mixtures(model: Model, like: np.ndarray, rows: np.ndarray, penalty: float = PENALTY, steps: int = STEPS):
    """Chosen proportions, and the posterior of the single best language."""
    n, k = np.diff(rows), like.shape[1]
    single = np.add.reduceat(np.log(like), rows[:-1], axis=0)
    best = single.argmax(axis=1)
    sure = np.exp(single - single.max(axis=1, keepdims=True))
    sure = (sure / sure.sum(axis=1, keepdims=True))[np.arange(len(n)), best]
    out = np.zeros((len(n), k), like.dtype)
    out[np.arange(len(n)), best] = 1
    score = single.max(axis=1)
    if k > 1:
        full, _ = em(like, rows, np.ones((len(n), k)), steps)
        order = np.argsort(-full, axis=1, kind="stable")
        live = np.flatnonzero(np.sort(full, axis=1)[:, -2] > 0.01)
        for size in range(2, k + 1):
            if not len(live):
                break
            words = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in live])
            to = np.concatenate(([0], np.cumsum(n[live])))
            start = np.zeros((len(live), k))
            np.put_along_axis(start, order[live, :size], 1.0, axis=1)
            pi, total = em(like[words], to, start, steps)
            gain = total - penalty * (size - 1) * np.log(n[live] + 1) / 2
            better = gain > score[live]
            win = live[better]
            out[win], score[win] = pi[better], gain[better]
            live = win if size == 2 else live[better]
    return out, sure


def predictor(model: Model, penalty: float = PENALTY):
    """A function from an Arrow string column to lists of lang, score, mixture, n_langs."""
    table, langs = letters_table(), model.langs

    def predict(col):
        lang, score, mix, size = ["und"] * len(col), [0.0] * len(col), [""] * len(col), [0] * len(col)
        # letters decide: symbols of scripts beyond ASCII alone are none
        has = pc.fill_null(pc.match_substring_regex(col, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not langs:
            return lang, score, mix, size
        # more languages, smaller steps: a step's table has about two million cells
        most = max(4096, (1 << 21) // max(4, len(langs)))
        for a, part, s, e, rows in read_words(col, most):
            live = np.flatnonzero((np.diff(rows) > 0) & has[a : a + len(rows) - 1])
            if not len(live):
                continue
            log = word_logs(model.logp, part, s, e, table, most)
            log -= log.max(axis=1, keepdims=True)
            like = np.exp(np.maximum(log, -25)).astype(np.float64)
            if len(live) < len(rows) - 1:
                words = np.concatenate([np.arange(rows[i], rows[i + 1]) for i in live])
                like, to = like[words], np.concatenate(([0], np.cumsum(np.diff(rows)[live])))
            else:
                to = rows
            pi, sure = mixtures(model, like, to, penalty)
            for i, p, q in zip((a + live).tolist(), pi, sure.tolist()):
                top = np.flatnonzero(p > 0)
                top = top[np.argsort(-p[top], kind="stable")]
                lang[i], size[i] = langs[top[0]], len(top)
                score[i] = float(min(1.0, q if len(top) == 1 else p[top[0]]))
                mix[i] = ",".join(f"{langs[j]}:{p[j]:.4f}" for j in top)
        return lang, score, mix, size

    return predict


def language_column(docs: DataFrame, model: Model, text_col: str = "text", penalty: float = PENALTY) -> Column:
    """A struct column (lang, score, mixture, n_langs) for the texts of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(texts: pd.Series) -> pd.DataFrame:
        got = predictor(Model(*shared.value), penalty)(pa.array(texts, pa.string(), from_pandas=True))
        return pd.DataFrame(dict(zip(("lang", "score", "mixture", "n_langs"), got)))

    return F.pandas_udf(run, OUT)(F.col(text_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, lang_pred, score, mixture, n_langs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), language_column(docs, model, text_col).alias("l"))
    return rows.select("doc_id", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.mixture").alias("mixture"), F.col("l.n_langs").alias("n_langs"))
