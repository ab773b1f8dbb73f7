"""Context keys: which edition, sport and event a name or title speaks of.

Everything is a Column expression; the vocabulary of sports is a dimension table that
with_context() joins names with, however many sports there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import norm_key, normalize_name, strip

# Patterns that define the results (fixed values).
EDITION = r"(?i)\b(\d{4})\s+(Summer|Winter)\s+Olympics\b"
CANONICAL = r"(?i)^(.+?)\s+at\s+the\s+(\d{4})\s+(Summer|Winter)\s+Olympics(?:\s*[–-]\s*(.+))?$"
ROUNDS = r"(final\s+[ab]\b|finals?|semi[\s-]*finals?|quarter[\s-]*finals?|heats?|repechage|qualifications?|heat\s+\d+|round\s+\d+)"
ROUND_PREFIX = rf"(?i)^(?:the\s+)?{ROUNDS}\s*(?:of|for|at|in)\s+"
ROUND_SUFFIX = rf"(?i)[\s,]+(?:{ROUNDS})\s*$"
BOILERPLATE = r"(?i)[\s,]+\b(event|competition|race|contest)\s*$"
CONNECTOR_TAIL = r"(?i)[\s,]+(?:(?:at|in|of|for|during|the)\s*)+$"
CONNECTOR_HEAD = r"(?i)^(?:(?:at|in|of|for|during|the)\s+)+"
YEAR = r"\b(1[89]\d{2}|20\d{2})\b"
EVENTISH = r"(?i)\d|metre|meter|\bkg\b|\bmen\b|\bwomen\b|heat|final|semi|quarter|repechage|race|competition"
#: Key prefix -> (level, specificity); others are (edition, 1).
LEVELS = {"event": ("event", 4), "discipline": ("event", 4), "sport": ("sport", 3), "olympics": ("edition", 2), "year": ("edition", 1), "topic": ("edition", 1)}
HIERARCHY = ("event", "sport", "olympics")
PREFIXES = ("olympics", "sport", "event", "year", "topic", "discipline")


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(" ,–-"))


def strip_rounds(x: Column) -> Column:
    """An event without heats, finals and the like around it."""
    for pattern in (ROUND_PREFIX, ROUND_SUFFIX, BOILERPLATE):
        x = F.regexp_replace(x, pattern, "")
    return _trim(x)


def sport_slot(title: Column) -> Column:
    """The sport of a canonical title, '' for others."""
    return strip(F.regexp_extract(F.coalesce(title, F.lit("")), CANONICAL, 1))


def sports(titles: DataFrame, title_col: str = "title") -> DataFrame:
    """The distinct sports of canonical titles: (sport)."""
    return titles.select(sport_slot(F.col(title_col)).alias("sport")).where("sport <> ''").distinct()


def _sports_in(names: DataFrame, known: DataFrame) -> DataFrame:
    """names(_name), known(sport, n) -> _name, _sport: the longest sport named in a text
    (ties: first by name). Runs of words, no longer than the longest sport, meet the
    dimension in an equi-join."""
    words = F.split(normalize_name(F.col("_name")), " ")
    most = known.agg(F.coalesce(F.max(F.size(F.split("n", " "))), F.lit(1)).alias("_w"))  # one row
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.col("_w"), F.size(words) - i + 1)), lambda k: F.array_join(F.slice(words, i, k), " "))))
    grams = names.join(F.broadcast(most)).select("_name", F.explode(F.array_distinct(runs)).alias("n"))
    order = F.struct((-F.length("n")).alias("l"), "sport")
    return grams.join(known, "n").groupBy("_name").agg(F.min(order).alias("o")).select("_name", F.col("o.sport").alias("_sport"))


def with_context(rows: DataFrame, name_col: str, sports_: DataFrame, out: str = "context") -> DataFrame:
    """rows with derive_context() of a column, given sports()."""
    known = sports_.select("sport", normalize_name(F.col("sport")).alias("n")).where("n <> ''").distinct()
    names = rows.select(F.col(name_col).alias("_name")).where("_name is not null").distinct()
    slots = names.withColumn("n", normalize_name(sport_slot(F.col("_name")))).join(known.select("n").distinct(), "n", "left_semi").select("_name", F.lit(True).alias("_fits"))
    none = known.agg((F.count("*") == 0).alias("_none"))  # one row
    found = names.join(_sports_in(names, known), "_name", "left").join(slots, "_name", "left").join(F.broadcast(none))
    found = found.select(F.col("_name"), F.coalesce("_sport", F.lit("")).alias("_sport"), (F.coalesce("_fits", F.lit(False)) | F.col("_none")).alias("_fits"))
    value = F.when(F.col("_name").isNotNull(), derive_context(F.col(name_col), F.col("_sport"), F.col("_fits")))
    return rows.join(found, F.col(name_col) == F.col("_name"), "left").withColumn(out, value).drop("_name", "_sport", "_fits")


def without(text: Column, part: Column) -> Column:
    """text without the first occurrence of part, case aside."""
    at = F.position(F.lower(part), F.lower(text))
    return F.when((part == "") | (at == 0), text).otherwise(F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part))))


def _let(x: Column, body) -> Column:
    """body(x) with x computed once: nested use would copy its expression."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def derive_context(name: Column, sport: Column, fits: Column) -> Column:
    """struct(root_context, context_path, context_keys, context_level); null for null and
    blank names. sport: the longest known one that the name holds; fits: whether the
    sport slot of a canonical title is a known sport."""

    def parts(raw):
        mention = F.regexp_extract(raw, EDITION, 0)
        return _let(F.struct(raw.alias("raw"), mention.alias("mention"), F.position(mention, raw).alias("at"), F.regexp_extract(raw, CANONICAL, 1).alias("slot"), strip(F.regexp_extract(raw, CANONICAL, 4)).alias("slot_event"), sport.alias("known"), fits.alias("fits")), choose)

    def choose(p):
        canonical = (p["slot"] != "") & ~F.regexp_like(p["slot"], F.lit(EVENTISH)) & (p["fits"] | (F.regexp_count(p["slot"], F.lit(r"\S+")) <= 2))
        # other names: the texts around the edition, cleaned by words
        before = strip_rounds(_trim(F.regexp_replace(F.substr(p["raw"], F.lit(1), p["at"] - 1), CONNECTOR_TAIL, "")))
        after = strip_rounds(_trim(F.regexp_replace(F.substr(p["raw"], p["at"] + F.length(p["mention"])), CONNECTOR_HEAD, "")))
        loose = _let(F.struct(F.coalesce(F.nullif(after, F.lit("")), before).alias("event"), p["known"].alias("sport")), lambda x: _let(F.struct(x["event"].alias("event"), x["sport"].alias("sport"), normalize_name(x["event"]).alias("e"), normalize_name(x["sport"]).alias("s")), apart))
        both = F.when(canonical, F.struct(strip(p["slot"]).alias("sport"), strip_rounds(p["slot_event"]).alias("event"))).otherwise(loose)
        root = F.concat_ws(" ", F.regexp_extract(p["mention"], EDITION, 1), F.initcap(F.regexp_extract(p["mention"], EDITION, 2)), F.lit("Olympics"))
        games = _let(both, lambda x: _let(F.struct(x["sport"].alias("sport"), x["event"].alias("event"), normalize_name(x["event"]).alias("e"), normalize_name(x["sport"]).alias("s"), root.alias("root")), checked))
        return F.when(p["raw"] == "", F.lit(None)).when(p["mention"] != "", games).otherwise(self_rooted(p["raw"]))

    def apart(x):
        inside = F.contains(F.concat(F.lit(" "), x["e"], F.lit(" ")), F.concat(F.lit(" "), x["s"], F.lit(" ")))
        event = F.when((x["sport"] == "") | (x["event"] == ""), x["event"]).when(x["e"] == x["s"], "").when(inside, strip_rounds(without(x["event"], x["sport"]))).otherwise(x["event"])
        return F.struct(x["sport"].alias("sport"), strip_rounds(event).alias("event"))

    def checked(x):
        same = (x["event"] == "") | (x["e"] == x["s"]) | (x["e"] == normalize_name(x["root"]))
        sport, event = F.when(x["sport"] != "", x["sport"]), F.when(~same, x["event"])
        return F.struct(
            x["root"].alias("root_context"),
            F.array_compact(F.array(x["root"], sport, event)).alias("context_path"),
            F.array_compact(F.array(F.concat(F.lit("olympics:"), F.left(x["root"], F.lit(4))), F.when(sport.isNotNull(), F.concat(F.lit("sport:"), F.translate(x["s"], " ", "_"))), F.when(~same, F.concat(F.lit("event:"), F.translate(x["e"], " ", "_"))))).alias("context_keys"),
            F.when(~same, "event").when(x["sport"] != "", "sport").otherwise("edition").alias("context_level"),
        )

    def self_rooted(raw):
        year = F.regexp_extract(raw, YEAR, 1)
        return F.struct(raw.alias("root_context"), F.array(raw).alias("context_path"), F.array_compact(F.array(F.concat(F.lit("topic:"), norm_key(raw)), F.when(year != "", F.concat(F.lit("year:"), year)))).alias("context_keys"), F.lit("edition").alias("context_level"))

    return _let(strip(F.coalesce(name, F.lit(""))), parts)


def merge_contexts(event: Column, title: Column) -> Column:
    """The event's context, its gaps filled from the title's."""

    def both(p):
        e, t = p["e"], p["t"]
        old = F.transform(e["context_path"], normalize_name)
        fresh = F.filter(t["context_path"], lambda x: ~F.array_contains(old, normalize_name(x)))
        root = F.when(t["context_level"].isin("sport", "event"), t["root_context"]).otherwise(e["root_context"])
        level = F.when((e["context_level"] == "edition") & (t["context_level"] != "edition"), "sport").otherwise(e["context_level"])
        merged = F.struct(root.alias("root_context"), F.concat(e["context_path"], F.array_distinct(fresh)).alias("context_path"), F.array_union(e["context_keys"], t["context_keys"]).alias("context_keys"), level.alias("context_level"))
        return F.when(e.isNull(), t).when(t.isNull(), e).otherwise(merged)

    return _let(F.struct(event.alias("e"), title.alias("t")), both)


def encode(keys: Column) -> Column:
    return F.to_json(keys)


def decode(text: Column) -> Column:
    """A JSON list as an array without empty entries; other text is one entry."""
    read = F.coalesce(F.from_json(text, "array<string>"), F.array(text))
    return F.filter(read, lambda x: x.isNotNull() & (x != ""))


def key_prefix(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def key_level(key: Column) -> Column:
    return F.when(key_prefix(key).isin("event", "discipline"), "event").when(key_prefix(key) == "sport", "sport").otherwise("edition")


def key_specificity(key: Column) -> Column:
    p = key_prefix(key)
    return F.when(p.isin("event", "discipline"), 4).when(p == "sport", 3).when(p == "olympics", 2).otherwise(1)


def key_display(key: Column) -> Column:
    return F.translate(F.regexp_replace(key, r"^[^:]*:", ""), "_", " ")


def season_of(root: Column) -> Column:
    low = F.lower(root)
    return F.when(F.contains(low, F.lit("summer")), "summer").when(F.contains(low, F.lit("winter")), "winter").otherwise("")


def expansion_ladder(keys: list[str]) -> list[str]:
    """The broader key prefixes to try next, nearest first."""
    rank = lambda p: LEVELS.get(p.split(":", 1)[0], ("edition", 1))[1]
    if not keys:
        return list(reversed(HIERARCHY[1:]))
    broadest = min(rank(k) for k in keys)
    return sorted((p for p in HIERARCHY if rank(p) < broadest), key=rank, reverse=True)
