"""Main-text extraction by a recurrent block labeller.

A page is read into its sequence of leaf blocks: stretches of text between block
tags, each with the path of open elements above it. A block's vector holds hashed
path tokens (tags, classes, ids, roles and their words), hashed words, and a few
numbers (length, share of linked text, punctuation, depth). A bidirectional LSTM
in numpy reads the whole sequence and labels every block main text or not, so a
block is judged with the context of the whole page. The labeller is trained on
the driver, from a fixed seed, on pages of html_pages.

Scripts, styles, comments, templates and the head are never text. Character
references are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by newlines in page order.

Defined results: null and empty pages give an empty text; broken markup is read
as far as it goes (unclosed tags stay open, stray end tags are ignored); repeated
rows are read each; an empty table gives an empty result; extra columns are
ignored by extract().
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import html_pages

# Element names with a fixed meaning in HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul button label textarea video audio canvas object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math head noembed noframes xmp".split())
CLOSES_P = BLOCK - frozenset("button label option select body html".split())
#: An open element of the first kind ends when one of the second begins.
ENDS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
ENDED = {new: tuple(old for old, by in ENDS.items() if new in by) for new in frozenset().union(*ENDS.values())}
FENCE = frozenset("ul ol dl table article section div nav aside body form".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
GOLD = re.compile(r"\sdata-gold=")
PIECE = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
SPACE = re.compile(r"[ \t\n\r\f\v   -     　]+")
WORD = re.compile(r"\w+")

PATHS, WORDS, NUMBERS, HIDDEN = 256, 32, 6, 24
INPUT = PATHS + WORDS + NUMBERS


def path_tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for m in ATTR.finditer(attrs) if attrs else ():
        value = m[2] or m[3] or m[4] or ""
        for name in value.split():
            out.append("." + name.lower())
            out += ("~" + p.lower() for p in PIECE.findall(name) if len(p) > 1)
    return tuple(dict.fromkeys(out))


class Stack:
    """Open elements. A node (parent, tokens, depth) stands for an element with all
    above it, so that a path costs the same at any depth."""

    def __init__(self):
        self.open: list[tuple] = []  # (tag, node, gold)
        self.count: dict[str, int] = {}
        self.nodes: list[tuple] = []
        self.gold = 0

    def push(self, tag: str, tokens: tuple, gold: bool):
        above = self.open[-1][1] if self.open else -1
        self.nodes.append((above, tokens, self.nodes[above][2] + 1 if above >= 0 else 1))
        self.open.append((tag, len(self.nodes) - 1, gold))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.gold += gold

    def close(self, tags, fence):
        """Close up to the innermost element of `tags`, unless one of `fence` is nearer."""
        if not any(self.count.get(t) for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                for tag, _, gold in self.open[i:]:
                    self.count[tag] -= 1
                    self.gold -= gold
                del self.open[i:]
                return
            if self.open[i][0] in fence:
                return

    @property
    def top(self) -> int:
        return self.open[-1][1] if self.open else -1


def blocks(page: str, marked: bool = False) -> tuple[list[tuple], list[tuple]]:
    """(node, text, linked letters, marked) of each leaf block, and the nodes (see
    Stack). `marked` looks for the training attribute."""
    out: list[tuple] = []
    stack = Stack()
    text: list[str] = []
    linked = 0
    at = 0

    def flush():
        nonlocal linked
        if text:
            s = SPACE.sub(" ", entities.unescape("".join(text))).strip(" ")
            if s:
                out.append((stack.top, s, linked, stack.gold > 0))
            text.clear()
        linked = 0

    while True:
        m = TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            text.append(piece)
            if stack.count.get("a"):
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            stack.close((tag,), frozenset() if tag in BLOCK else FENCE)
            continue
        if tag in RAW:
            if tag in BLOCK:
                flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag == "head":
                body = re.compile(r"<body", re.I).search(page, at)
                at = body.start() if body else at
            else:
                at = len(page)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                stack.close(("p",), FENCE)
            if tag in ENDED:
                stack.close(ENDED[tag], FENCE)
        if tag not in VOID and not m[3].endswith("/"):
            stack.push(tag, path_tokens(tag, m[3]), bool(marked and GOLD.search(m[3])))
    flush()
    return out, stack.nodes


class Features:
    """Vectors of a page's blocks; hashes of tokens are remembered."""

    def __init__(self):
        self.memo: dict = {}

    def place(self, token: str, size: int, salt: str) -> tuple[int, float]:
        got = self.memo.get((token, salt))
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            h = zlib.crc32((salt + token).encode())
            got = self.memo[(token, salt)] = (h % size, 1.0 if h & 0x80000000 else -1.0)
        return got

    def tokens(self, tokens: tuple) -> np.ndarray:
        got = self.memo.get(tokens)
        if got is None:
            got = np.zeros(PATHS, np.float32)
            for t in tokens:
                i, sign = self.place(t, PATHS, "p")
                got[i] += sign
            self.memo[tokens] = got
        return got

    def paths(self, nodes: list[tuple], wanted: set) -> dict[int, np.ndarray]:
        """Path vectors of the wanted nodes: 0.7 of all elements above, and 0.3 more of the inner three."""
        sums, out = {-1: np.zeros(PATHS, np.float32)}, {-1: np.zeros(PATHS, np.float32)}
        for n, (above, tokens, _) in enumerate(nodes):
            sums[n] = sums[above] + np.float32(0.7) * self.tokens(tokens)
            if n in wanted:
                inner, up = sums[n].copy(), n
                for _ in range(3):
                    if up >= 0:
                        inner += np.float32(0.3) * self.tokens(nodes[up][1])
                        up = nodes[up][0]
                out[n] = inner
        return out

    def page(self, found: list[tuple], nodes: list[tuple]) -> np.ndarray:
        x = np.zeros((len(found), INPUT), np.float32)
        paths = self.paths(nodes, {f[0] for f in found})
        for i, (node, text, linked, _) in enumerate(found):
            x[i, :PATHS] = paths[node]
            words = WORD.findall(text)
            for w in words:
                j, sign = self.place(w.lower(), WORDS, "w")
                x[i, PATHS + j] += sign
            x[i, PATHS : PATHS + WORDS] /= 4 * np.sqrt(max(1, len(words)))
            n = len(text)
            x[i, PATHS + WORDS :] = (np.log1p(len(words)) / 4, min(1.0, linked / n), text.count(",") * 8 / (n + 8), text[-1] in ".!?", min(8.0, (nodes[node][2] if node >= 0 else 0) / 12), 1.0)
        return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    out = {}
    for d in ("f", "b"):
        out["W" + d] = r.normal(0, 1 / np.sqrt(40), (INPUT, 4 * HIDDEN)).astype(np.float32)
        out["U" + d] = r.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        out["c" + d] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
    out["V"] = r.normal(0, 0.2, (2 * HIDDEN, 1)).astype(np.float32)
    out["v"] = np.zeros(1, np.float32)
    return out


def _one_way(p, d, x, mask, keep=False):
    """States of an LSTM over x (time, pages, inputs); mask 0 keeps the state."""
    t, b, _ = x.shape
    z = x.reshape(t * b, -1) @ p["W" + d] + p["c" + d]
    z = z.reshape(t, b, -1)
    h = c = np.zeros((b, HIDDEN), np.float32)
    out, tape = np.zeros((t, b, HIDDEN), np.float32), []
    for i in range(t) if d == "f" else range(t - 1, -1, -1):
        a = z[i] + h @ p["U" + d]
        g = _sigmoid(a[:, : 3 * HIDDEN])
        u = np.tanh(a[:, 3 * HIDDEN :])
        m = mask[i][:, None]
        cell = g[:, HIDDEN : 2 * HIDDEN] * c + g[:, :HIDDEN] * u
        tc_ = np.tanh(cell)
        state = g[:, 2 * HIDDEN :] * tc_
        if keep:
            tape.append((i, h, c, g, u, tc_))
        c = m * cell + (1 - m) * c
        h = m * state + (1 - m) * h
        out[i] = h
    return out, tape


def _back(p, grads, d, x, mask, tape, dout):
    t, b, _ = x.shape
    dz = np.zeros((t, b, 4 * HIDDEN), np.float32)
    dh = np.zeros((b, HIDDEN), np.float32)
    dc = np.zeros((b, HIDDEN), np.float32)
    for i, h0, c0, g, u, tc_ in reversed(tape):
        m = mask[i][:, None]
        dh = dh + dout[i]
        ds, dh_skip = dh * m, dh * (1 - m)
        gi, gf, go = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
        dcell = dc * m + ds * go * (1 - tc_**2)
        da = np.concatenate([dcell * u * gi * (1 - gi), dcell * c0 * gf * (1 - gf), ds * tc_ * go * (1 - go), dcell * gi * (1 - u**2)], axis=1)
        dz[i] = da
        grads["U" + d] += h0.T @ da
        dh = da @ p["U" + d].T + dh_skip
        dc = dcell * gf + dc * (1 - m)
    flat = dz.reshape(t * b, -1)
    grads["W" + d] += x.reshape(t * b, -1).T @ flat
    grads["c" + d] += flat.sum(axis=0)


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(len(s) for s in seqs)
    x, mask = np.zeros((t, len(seqs), INPUT), np.float32), np.zeros((t, len(seqs)), np.float32)
    for j, s in enumerate(seqs):
        x[: len(s), j], mask[: len(s), j] = s, 1
    return x, mask


def forward(p, x, mask):
    f, _ = _one_way(p, "f", x, mask)
    b, _ = _one_way(p, "b", x, mask)
    return _sigmoid((np.concatenate([f, b], axis=2) @ p["V"])[..., 0] + p["v"])


def train(n_pages: int = 1500, epochs: int = 8, batch: int = 32, rate: float = 0.006, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights learned with Adam from synthetic pages; the same on each call."""
    feats, data = Features(), []
    for page in html_pages.pages(n_pages, seed):
        found, nodes = blocks(page, marked=True)
        if found:
            data.append((feats.page(found, nodes), np.array([b[3] for b in found], np.float32)))
    p = initial()
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    r, step = np.random.default_rng(seed), 0
    for epoch in range(epochs):
        order = np.argsort([len(y) + r.random() * 6 for _, y in data])
        groups = [order[i : i + batch] for i in range(0, len(order), batch)]
        r.shuffle(groups)
        for group in groups:
            x, mask = padded([data[i][0] for i in group])
            # words and path tokens are dropped at random, so that no single name decides
            x[..., :PATHS] *= (r.random((1, len(group), PATHS)) > 0.15).astype(np.float32)
            y = np.zeros_like(mask)
            for j, i in enumerate(group):
                y[: len(data[i][1]), j] = data[i][1]
            f, ft = _one_way(p, "f", x, mask, True)
            b, bt = _one_way(p, "b", x, mask, True)
            h = np.concatenate([f, b], axis=2)
            prob = _sigmoid((h @ p["V"])[..., 0] + p["v"])
            d = (prob - y) * mask / mask.sum()
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            grads["V"] += np.einsum("tbh,tb->h", h, d)[:, None]
            grads["v"] += d.sum()
            dh = d[..., None] * p["V"][:, 0]
            _back(p, grads, "f", x, mask, ft, dh[..., :HIDDEN])
            _back(p, grads, "b", x, mask, bt, dh[..., HIDDEN:])
            step += 1
            lr = rate * (1 - 0.9 * epoch / epochs)
            for k in p:
                g = np.clip(grads[k], -1, 1)
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.99 * m2[k] + 0.01 * g * g
                p[k] = p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype(np.float32) for k, v in p.items()}


_trained: dict = {}


def weights() -> dict[str, np.ndarray]:
    """The default labeller, trained once per driver process."""
    if "w" not in _trained:
        _trained["w"] = train()
    return _trained["w"]


def label(p: dict, seqs: list[np.ndarray], cells: int = 4096) -> list[np.ndarray]:
    """Probabilities of main text; pages of like length go through together."""
    out: list = [np.zeros(0, np.float32)] * len(seqs)
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: len(seqs[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 256 and len(seqs[order[end]]) * (end - at + 1) <= cells:
            end += 1
        group = order[at:end]
        prob = forward(p, *padded([seqs[i] for i in group]))
        for j, i in enumerate(group):
            out[i] = prob[: len(seqs[i]), j]
        at = end
    return out


def main_texts(p: dict, feats: Features, pages: list[str | None]) -> list[str]:
    found = [blocks(h) if h else ([], []) for h in pages]
    probs = label(p, [feats.page(*f) for f in found])
    return ["\n".join(b[1] for b, q in zip(bs, qs) if q >= 0.5) for (bs, _), qs in zip(found, probs)]


def text_column(pages: DataFrame, html_col: str = "html", model: dict | None = None) -> Column:
    """The main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or weights())
    kept: dict = {}

    def run(col: pd.Series) -> pd.Series:
        feats = kept.setdefault("f", Features())
        rows = [h if isinstance(h, str) else None for h in col]
        return pd.Series([t for i in range(0, len(rows), 200) for t in main_texts(shared.value, feats, rows[i : i + 200])], dtype=object)

    return F.pandas_udf(run, "string")(F.col(html_col))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: dict | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    out = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(text_column(pages, html_col, model), F.lit("")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
