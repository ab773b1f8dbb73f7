"""Prompts as columns: numbered blocks, capped lists and the texts around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

from .investigate import CAPS, MAX_STEPS
from .search import last_steps

# How much of each list a prompt shows (fixed values).
PATHS, CHUNKS, CHUNK_CHARS, QUERY_CHARS, HISTORY, CONTEXTS = 20, 14, 600, 60, 6, 4


def lines(rows: DataFrame, line: Column, *order: str, most: int | None = None, name: str = "lines") -> DataFrame:
    """qid, lines: the rows' lines in order, one below the other, the first `most`."""
    keyed = rows.select("qid", F.struct(*order, line.alias("line")).alias("x"))
    if most is not None:
        place = F.row_number().over(Window.partitionBy("qid").orderBy("x"))
        keyed = keyed.withColumn("n", place).where(F.col("n") <= most)
    return keyed.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\n").alias(name))


def _with(base: DataFrame, part: DataFrame, name: str, none: str) -> DataFrame:
    return base.join(part, "qid", "left").withColumn(name, F.coalesce(name, F.lit(none)))


def slot_lines(slots: DataFrame, typed: bool = False) -> DataFrame:
    kind = F.concat(F.lit(" ("), F.coalesce("slot_type", F.lit("relational")), F.lit(")")) if typed else F.lit("")
    return lines(slots, F.concat(F.lit("- "), "slot", kind, F.lit(": "), "question"), "slot", name="slots")


def path_lines(paths: DataFrame) -> DataFrame:
    return lines(paths, F.concat(F.lit("  "), "path"), "position", most=PATHS, name="paths")


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """chunks(qid, position, chunk_id, source, support, text)."""
    text = F.translate(F.left(F.coalesce("text", F.lit("")), F.lit(CHUNK_CHARS)), "\n", " ")
    line = F.concat(F.lit("  ["), "chunk_id", F.lit("] ("), F.coalesce("source", F.lit("graph")), F.lit(", support="), F.coalesce(F.col("support").cast("string"), F.lit("0")), F.lit(") "), text)
    return lines(chunks, line, "position", most=CHUNKS, name="chunks")


def status_lines(statuses: DataFrame) -> DataFrame:
    """statuses(qid, slot, status, support_score)."""
    return lines(statuses, F.concat(F.lit("  "), "slot", F.lit(": "), "status", F.lit(" (support="), F.format_string("%.2f", "support_score"), F.lit(")")), "slot", name="statuses")


def history_lines(trace: DataFrame) -> DataFrame:
    """trace(qid, step, tool, subquery, result): the last steps."""
    line = F.concat(F.lit("  step "), F.col("step").cast("string"), F.lit(": "), "tool", F.lit(" query="), F.left(F.coalesce("subquery", F.lit("")), F.lit(QUERY_CHARS)), F.lit(" -> "), F.coalesce("result", F.lit("")))
    return lines(last_steps(trace, HISTORY), line, "step", name="history")


def context_lines(roots: DataFrame, investigated: DataFrame | None = None) -> DataFrame:
    """roots() of each question, those investigated(qid, key) marked."""
    rows = roots if investigated is None else roots.join(investigated.select("qid", "key").distinct().withColumn("seen", F.lit(" (investigated)")), ["qid", "key"], "left")
    mark = F.lit("") if investigated is None else F.coalesce("seen", F.lit(""))
    line = F.concat(F.lit("  "), "key", F.lit(" ["), "level", F.lit("] ~"), F.col("n_events").cast("string"), F.lit(" events"), mark)
    return lines(rows, line, "root_rank", name="contexts")


def budget_line(state: DataFrame) -> DataFrame:
    """qid, budget: steps and calls used, of those allowed."""
    used = [F.concat(F.lit("steps "), F.col("step").cast("string"), F.lit(f"/{MAX_STEPS}"))]
    used += [F.concat(F.lit(c.split("_")[0] + " calls "), F.col(c).cast("string"), F.lit(f"/{n}")) for c, n in CAPS.values()]
    return state.select("qid", F.concat_ws(", ", *used).alias("budget"))


def planner_prompt(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.concat(F.lit("Question:\n"), "query", F.lit("\n\nSplit it into answer slots; name its type, its scope and candidate context keys. Answer as JSON.")).alias("prompt"))


def entity_prompt(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.concat(F.lit("Query:\n"), "query", F.lit("\n\nList the named entities in it as JSON.")).alias("prompt"))


def extraction_prompt(chunks: DataFrame) -> DataFrame:
    """chunks(chunk_id, title, text) -> chunk_id, prompt."""
    return chunks.select("chunk_id", F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nText:\n"), "text", F.lit("\n\nList its entities and action events with their relations as JSON.")).alias("prompt"))


def answer_prompt(questions: DataFrame, context: DataFrame) -> DataFrame:
    """The question over the numbered blocks of build_context()."""
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), "text")
    rows = _with(questions.select("qid", "query"), lines(context, block, "position", name="blocks"), "blocks", "(none)")
    return rows.select("qid", F.concat(F.lit("Question: "), "query", F.lit("\n\nContext:\n"), "blocks", F.lit("\n\nAnswer from the context alone and cite block numbers.")).alias("prompt"))


def evaluator_prompt(questions: DataFrame, slots: DataFrame, paths: DataFrame, chunks: DataFrame, unmatched: DataFrame) -> DataFrame:
    rows = _with(questions.select("qid", "query"), slot_lines(slots, True), "slots", "")
    rows = _with(_with(rows, path_lines(paths), "paths", "  (none)"), chunk_lines(chunks), "chunks", "  (none)")
    names = unmatched.groupBy("qid").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mention_ord", "mention"))), lambda x: x["mention"]), ", ").alias("unmatched"))
    rows = _with(rows, names, "unmatched", "none")
    return rows.select("qid", F.concat(F.lit("Question: "), "query", F.lit("\n\nSlots:\n"), "slots", F.lit("\n\nPaths:\n"), "paths", F.lit("\n\nChunks:\n"), "chunks", F.lit("\n\nNot in the graph: "), "unmatched", F.lit("\n\nJudge each slot as JSON.")).alias("prompt"))


def supervisor_prompt(questions: DataFrame, slots: DataFrame, statuses: DataFrame, trace: DataFrame, state: DataFrame, roots: DataFrame, investigated: DataFrame | None = None) -> DataFrame:
    rows = _with(questions.select("qid", "query"), slot_lines(slots), "slots", "")
    rows = _with(rows, status_lines(statuses), "statuses", "  (none yet)")
    rows = _with(rows, history_lines(trace), "history", "  (none yet)")
    rows = _with(rows, context_lines(roots.where(F.col("root_rank") <= CONTEXTS), investigated), "contexts", "  (none)")
    rows = _with(rows, budget_line(state), "budget", "")
    parts = (("Question: ", "query"), ("\n\nSlots:\n", "slots"), ("\n\nStatuses:\n", "statuses"), ("\n\nHistory:\n", "history"), ("\n\nContexts:\n", "contexts"), ("\n\nBudget: ", "budget"))
    return rows.select("qid", F.concat(*[x for head, name in parts for x in (F.lit(head), F.col(name))], F.lit("\n\nChoose the next action as JSON.")).alias("prompt"))
