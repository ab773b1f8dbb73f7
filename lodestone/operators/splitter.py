"""Token-bounded chunks that end at paragraphs, lines or words where they can.

A text is cut at the first separator of the list that it holds; pieces keep the
separator in front of them. Pieces that are too long are cut again at the next
separator, the others are packed, in order, into chunks of at most `size` tokens; a
chunk begins with the last pieces of the one before, `overlap` tokens of them at most.
Lengths are counted once for each piece, by a tokenizer that is given by name: `words`
(white space), or the path of a rank file of byte pairs.

Python is needed here: packing is sequential and tokenizers are no SQL functions. Rows
go through in Arrow batches, each text on its own, and whole.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST_BODY = 512, 54, 50
SEPARATORS = ("\n\n", "\n", " ", "")
#: How byte-pair vocabularies cut a text before merging (fixed value).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "chunk_id string, doc_id string, title string, chunk_index int, token_count int, page string"


@lru_cache(maxsize=4)
def counter(tokenizer: str) -> Callable[[str], int]:
    """text -> number of tokens."""
    if tokenizer == "words":
        return lambda text: len(text.split())
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(tokenizer).read_bytes().splitlines() if line)}
    pairs = tiktoken.Encoding("chunks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(pairs.encode_ordinary(text))


def pieces(text: str, separator: str) -> list[str]:
    """The text cut before each separator; without one, its characters."""
    if not separator:
        return list(text)
    at = [m.start() for m in re.finditer(re.escape(separator), text)]
    edges = [0, *(i for i in at if i), len(text)]
    return [text[i:j] for i, j in zip(edges, edges[1:]) if i < j]


def pack(parts: list[tuple[str, int]], size: int, overlap: int) -> list[str]:
    """Chunks of parts (text, tokens), in order."""
    out, held, total, first = [], [], 0, 0
    for text, n in parts:
        if total + n > size:
            if held[first:]:
                out.append("".join(t for t, _ in held[first:]).strip())
            while total > overlap or (total and total + n > size):
                total -= held[first][1]
                first += 1
        held.append((text, n))
        total += n
    if held[first:]:
        out.append("".join(t for t, _ in held[first:]).strip())
    return [x for x in out if x]


def split(text: str, size: int, overlap: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The chunks of a text, white space around them stripped, none empty."""
    here = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    out, short = [], []
    for part in pieces(text, separators[here]):
        n = count(part)
        if n < size:
            short.append((part, n))
            continue
        out += pack(short, size, overlap)
        short = []
        rest = separators[here + 1 :]
        out += split(part, size, overlap, count, rest) if rest else [part]
    return out + pack(short, size, overlap)


def document_chunks(doc_id: str, title: str, text: str, size: int, overlap: int, count: Callable[[str], int]) -> list[tuple]:
    """OUT rows of one document; its title counts against the size and heads each chunk."""
    title = title.strip()
    body = max(LEAST_BODY, size - count(f"Title: {title}\n\n")) if title else size
    out = []
    for i, part in enumerate(split(text, body, overlap, count)):
        page = part if not title or part.startswith(f"Title: {title}") else f"Title: {title}\n\n{part}"
        out.append((f"{doc_id}_chunk_{i}", doc_id, title, i, count(page), page))
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, tokenizer: str = "words") -> DataFrame:
    """docs(doc_id, title, text) -> OUT, a row for each chunk. Null texts have none, a
    null title counts as empty."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches):
        count = counter(tokenizer)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(3))):
                rows = document_chunks(row[0], row[1] or "", row[2] or "", size, overlap, count)
                if rows:
                    cols = list(zip(*rows))
                    kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("string"), "title", "text").mapInArrow(run, OUT)
