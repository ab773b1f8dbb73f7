"""Scalars against goldens."""

from pyspark.sql import functions as F

from lodestone.functions import context as cx
from lodestone.functions import text as tx

CONTEXT = "struct<root_context:string,context_path:array<string>,context_keys:array<string>,context_level:string>"
SPORTS = ["Fencing", "Luge", "Water polo", "Polo", "Cycling"]


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.select(fn(F.col("x")), "i").orderBy("i").collect()]


def test_normalize_name(spark):
    raw = ["\tNew\u00a0 Zealand\n", "Women's C-4 (200m)", "THE Hague", "an, Apple_Pie/2", "a", "the", "x—y*z", "", None]
    got = values(spark, tx.normalize_name, raw)
    assert got == ["new zealand", "women s c 4 200m", "hague", "apple pie 2", "a", "the", "x y z", "", ""]
    assert values(spark, tx.normalize_name, got) == got


def test_clean_text(spark):
    raw = "[Infobox person]\nName\r\nA  b\t\tc  \n  d\n\n\n\ne\x07 "
    assert values(spark, tx.clean_text, [raw]) == ["Name\nA b c\nd\n\ne"]


def test_clean_query(spark):
    assert values(spark, tx.clean_query, ["<p>Hello&amp;World 😀 #1, ok.</p>", "Ünï &lt;b&gt;x"]) == ["hello world 1, ok.", "n x"]


def test_tokens_and_answers(spark):
    assert values(spark, tx.tokens, ["Don't, C-4 200m?", None]) == [["don", "t", "c", "4", "200m"], []]
    assert values(spark, tx.normalize_answer, ["\tMax --  Mustermann. "]) == ["max mustermann"]


def test_chunk_ids(spark):
    assert values(spark, tx.doc_of_chunk, ["Q1_chunk_2", "a_chunk_b_chunk_10", "x"]) == ["Q1", "a_chunk_b", ""]
    assert values(spark, tx.chunk_index, ["Q1_chunk_2", "x", "Q_chunk_y"]) == [2, -1, -1]


def test_stop_reason(spark):
    given = {"answered": "sufficient_evidence", "slots_are_supported_now": "sufficient_evidence", "no_new_evidence": "diminishing_returns", "duplicate_queries": "diminishing_returns", "over_budget": "budget_exhausted", "too_many_steps": "budget_exhausted", "no_useful_path": "no_useful_path", "bored": "no_useful_path", "": "no_useful_path"}
    assert values(spark, tx.stop_reason, list(given)) == list(given.values())


def test_single_digit(spark):
    assert values(spark, tx.drop_single_digit, ["x 7 y 42 z", "7 up"]) == ["x   y 42 z", "7 up"]


def test_chunk_id_falls_back(spark):
    df = spark.createDataFrame([(0, "a", "b", "c"), (1, "", "b", "c"), (2, None, "", "c"), (3, None, "", None)], "i int, x string, y string, z string")
    assert [r[0] for r in df.orderBy("i").select(tx.chunk_id(F.col("x"), F.col("y"), F.col("z"), ordinal=F.col("i"))).collect()] == ["a", "b", "c", "__index_3"]


def context(spark, names, sports=SPORTS):
    df = spark.createDataFrame(list(enumerate(names)), "i int, x string")
    known = spark.createDataFrame([(x,) for x in sports], "sport string")
    return [r["context"] for r in cx.with_context(df, "x", known).orderBy("i").collect()]


def test_derive_context(spark):
    names = ["Fencing at the 1996 Summer Olympics – Women's épée team", "Luge at the 2002 Winter Olympics", "Repechage of Women's sabre at the 1988 Summer Olympics", "Women's sabre semi-final in 1988 Summer Olympics", "Mixed water polo contest at the 2000 Summer Olympics", "Battle of Lepanto 1571, told in 1971", " ", None]
    full, sport, rep, semi, loose, war, blank, none = context(spark, names)
    assert full["root_context"] == "1996 Summer Olympics" and full["context_level"] == "event"
    assert full["context_keys"] == ["olympics:1996", "sport:fencing", "event:women_s_épée_team"]
    assert sport["context_keys"] == ["olympics:2002", "sport:luge"] and sport["context_level"] == "sport"
    assert rep["context_keys"] == semi["context_keys"] == ["olympics:1988", "event:women_s_sabre"]
    assert loose["context_keys"][:2] == ["olympics:2000", "sport:water_polo"]  # the longest sport, not polo
    assert war["context_keys"] == ["topic:battle_of_lepanto_1571_told_in_1971", "year:1971"] and war["context_level"] == "edition"
    assert blank is None and none is None


def test_context_with_many_sports(spark):
    many = [f"Game {i} of {i % 7}" for i in range(12_000)] + SPORTS
    (got,) = context(spark, ["Women's game 11999 of 1 race at the 2004 Summer Olympics"], many)
    assert "sport:game_11999_of_1" in got["context_keys"]
    assert context(spark, ["Anything at the 2004 Summer Olympics"], [])[0]["context_keys"][:2] == ["olympics:2004", "sport:anything"]


def test_merge_contexts(spark):
    e, t = context(spark, ["Qualifications of Women's keirin at the 2012 Summer Olympics", "Cycling at the 2012 Summer Olympics – Women's keirin"])
    df = spark.createDataFrame([(e, t)], f"e {CONTEXT}, t {CONTEXT}")
    m = df.select(cx.merge_contexts(F.col("e"), F.col("t"))).first()[0]
    assert m["context_keys"] == ["olympics:2012", "event:women_s_keirin", "sport:cycling"] and m["root_context"] == "2012 Summer Olympics"


def test_keys(spark):
    assert values(spark, cx.key_level, ["event:x", "discipline:y", "sport:a", "olympics:2000", "zzz"]) == ["event", "event", "sport", "edition", "edition"]
    assert values(spark, cx.key_specificity, ["event:x", "sport:a", "olympics:2000", "topic:q"]) == [4, 3, 2, 1]
    assert cx.expansion_ladder(["event:x"]) == ["sport", "olympics"]
    assert cx.expansion_ladder(["sport:x"]) == ["olympics"]
    assert cx.expansion_ladder(["olympics:2008"]) == []
    assert values(spark, lambda c: cx.decode(c), ['["a","","b"]', "plain"]) == [["a", "b"], ["plain"]]
