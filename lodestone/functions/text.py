"""Text scalars as Column -> Column functions, all on Catalyst built-ins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation that name keys treat as spaces (fixed values).
NAME_PUNCTUATION = "\"'`.,;:!?()[]{}<>-/&*–—―‒_"
#: Code points of emoji, arrows, symbols and joiners that queries lose (fixed ranges).
SYMBOL_RANGES = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200D}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{25A0}-\x{25FF}]+"
#: Character references that queries decode natively (fixed values).
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _chain(x: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        x = F.regexp_replace(x, pattern, to)
    return x


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """Normalise white space and drop infobox markers and control characters;
    tables and paragraphs keep their lines."""
    x = _chain(x, (r"(?d)\[Infobox.*?\]\n?", ""), (r"\r\n|\r", "\n"), (r"[\x00-\x08\x0B-\x1F\x7F]", ""), (" ", " "), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"))
    return strip(x)


def clean_query(x: Column) -> Column:
    """A raw query in lower case with a-z, 0-9, period, comma and single spaces."""
    for name, to in REFERENCES:
        x = F.replace(x, F.lit(name), F.lit(to))
    x = F.lower(_chain(x, (r"<[^>]+>", " "), (SYMBOL_RANGES, "")))
    return strip(_chain(x, (r"(?U)[^a-z0-9\s.,]", " "), (r"(?U)\s+", " ")))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 in lower case; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def normalize_name(x: Column) -> Column:
    """The key of an entity or event name: lower case, punctuation as spaces,
    single spaces, one leading article dropped if something follows."""
    x = F.translate(F.lower(strip(F.coalesce(x, F.lit("")))), NAME_PUNCTUATION, " " * len(NAME_PUNCTUATION))
    x = strip(F.regexp_replace(x, r"(?U)\s+", " "))
    return F.regexp_replace(x, r"^(the|a|an) (?=.)", "")


def norm_key(x: Column) -> Column:
    return F.translate(normalize_name(x), " ", "_")


def normalize_answer(x: Column) -> Column:
    x = F.lower(strip(F.coalesce(x, F.lit(""))))
    return strip(_chain(x, (r"[^a-z0-9 ]", " "), (r" +", " ")))


def prepend_title(title: Column, text: Column) -> Column:
    head = F.concat(F.lit("Title: "), title, F.lit("\n\n"))
    return F.when(F.startswith(text, head), text).otherwise(F.concat(head, text))


def count_tokens(x: Column) -> Column:
    """Tokens by white space: the offline stand-in for a BPE count."""
    return F.regexp_count(x, F.lit(r"(?U)\S+"))


def doc_of_chunk(x: Column) -> Column:
    return F.regexp_extract(x, r"(?s)^(.*)_chunk_", 1)


def chunk_index(x: Column) -> Column:
    """The number at the end of a chunk id, -1 if it is malformed."""
    n = F.regexp_extract(x, r"^.*_chunk_([0-9]+)$", 1)
    return F.when(n == "", F.lit(-1)).otherwise(n.try_cast("int"))


def chunk_id(*candidates: Column, ordinal: Column | None = None) -> Column:
    """The first id that is not empty, else __index_<ordinal>."""
    spare = [F.concat(F.lit("__index_"), ordinal.cast("string"))] if ordinal is not None else []
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], *spare)


def drop_single_digit(x: Column) -> Column:
    """A digit that stands alone between white space becomes a space."""
    return F.regexp_replace(x, r"(?<=\s)\d(?=\s)", " ")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def shorten(x: Column, most: int, mark: str = "…") -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit(mark))).otherwise(x)


def path_label(vtype: Column, vid: Column) -> Column:
    return shorten(F.concat_ws(":", vtype, vid), 44)


#: Stop reasons of the investigation loop, and codes that mean one of them (fixed values).
STOP_REASONS = ("sufficient_evidence", "diminishing_returns", "budget_exhausted", "no_useful_path")
STOP_CODES = {"all_slots_supported": STOP_REASONS[0], "all_required_slots_supported": STOP_REASONS[0], "answered": STOP_REASONS[0], "max_steps": STOP_REASONS[2], "duplicate_scope": STOP_REASONS[1], "no_new_evidence": STOP_REASONS[1]}


def stop_reason(x: Column) -> Column:
    """A reason code as one of STOP_REASONS: itself, by STOP_CODES, by what it contains."""
    exact = F.when(x.isin(*STOP_REASONS), x)
    for code, to in STOP_CODES.items():
        exact = exact.when(x == code, F.lit(to))
    for to, parts in ((STOP_REASONS[0], ("sufficient", "supported")), (STOP_REASONS[2], ("budget", "steps")), (STOP_REASONS[1], ("diminish", "duplicate"))):
        exact = exact.when(F.contains(x, F.lit(parts[0])) | F.contains(x, F.lit(parts[1])), F.lit(to))
    return exact.otherwise(F.lit(STOP_REASONS[3]))
