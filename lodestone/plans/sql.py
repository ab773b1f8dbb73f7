"""SQL expressions that repeat the scalar functions for the oracle."""

from __future__ import annotations

from lodestone.functions.text import NAME_PUNCTUATION


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def strip(x: str) -> str:
    return rx(x, r"^\s+|\s+$", "")


def clean_text(x: str) -> str:
    for p, to in ((r"\[Infobox[^\n]*?\]\n?", ""), (r"\r\n|\r", "\n"), (r"[\x00-\x08\x0B-\x1F\x7F]", ""), (" ", " "), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        x = rx(x, p, to)
    return strip(x)


def clean_query(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {quote(a)}, {quote(b)})"
    x = rx(x, "<[^>]+>", " ")
    x = rx(x, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{200D}\x{2190}-\x{21FF}\x{2300}-\x{23FF}\x{25A0}-\x{25FF}]+", "")
    return strip(rx(rx(f"lower({x})", r"[^a-z0-9\s.,]", " "), r"\s+", " "))


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def name(x: str) -> str:
    x = f"translate(lower({strip(x)}), {quote(NAME_PUNCTUATION)}, {quote(' ' * len(NAME_PUNCTUATION))})"
    return f"regexp_replace({strip(rx(x, chr(92) + 's+', ' '))}, '^(the|a|an) (.+)$', '\\2')"


def answer(x: str) -> str:
    return strip(rx(rx(f"lower({strip(x)})", "[^a-z0-9 ]", " "), " +", " "))
