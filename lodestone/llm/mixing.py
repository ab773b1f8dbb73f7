"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each document gets a rate r_i, close in relative entropy to taking every document
once, under one token constraint per source: sum(size_i * r_i) = target_s. The
solution is an exponential tilt, r_i = min(cap, exp(l_s * x_i)) with x_i the
document's size over its source's mean size, where l_s solves the convex dual
sum(exp(l_s * x_i)) - l_s * target_s / mean_s. A source that is to grow takes its
long documents more often, one that is to shrink its short ones. Newton's method
starts at l_s = 0, for all sources at once; each step is one aggregate over the
histogram of sizes, kept inside a bracket that every step narrows, and the loop
goes on until each gap is below the tolerance or the bracket has no inner point.

Rates become copies: a document takes floor(r_i) copies and one more if a hash of
its id, uniform in [0, 1), lies below the fraction of r_i plus a shift d_s. The
shift that meets the source's target is found by three refinements of a histogram
of 4,096 places, whatever the source's size, so that no row is moved and the sum
ends within one document of the target. One repair pass then gives or takes one
copy of the document that best closes the gap that is left. All sums are over
integers (rates count in units of 2^-20), so that reruns agree bit by bit.

Defined results: a null or blank text has size 0 and takes 0; a null source is a
source of its own, ordered last; a source without words has target 0; rows that
repeat an id are documents of their own, and those that are alike in id and size
get the same copies; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, remove, saved

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
#: Fixed point of rates, and of the place of a document (three times PLACE bits).
UNIT, PLACE = 20, 12


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """sources(source, source_size) -> source, source_size, target.

    Sources by code point, null last, take the weights in turn. A target stops
    at cap times its source's size; the excess is shared again by weight until
    no source is above. Each pass is one aggregate over the sources."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    state = saved(_weighed(sources, weights).withColumn("full", F.lit(False)), "mix-sources")
    goal, fresh = share * total, -1
    while True:
        held = state.agg(F.sum(F.when(F.col("full"), cap * F.col("source_size"))), F.sum(F.when(~F.col("full"), F.col("w"))), F.count_if("full")).first()
        rest, mass = goal - float(held[0] or 0), float(held[1] or 0)
        due = F.lit(max(rest, 0.0)) * F.col("w") / F.lit(mass if mass else 1.0)
        aimed = state.withColumn("target", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(due))
        if held[2] == fresh or not mass:
            break
        fresh = held[2]
        state = saved(aimed.withColumn("full", F.col("full") | (F.col("target") > cap * F.col("source_size"))).drop("target"), "mix-sources", (state,))
    return aimed.select("source", "source_size", F.least("target", (cap * F.col("source_size")).cast("double")).alias("target"))


def _weighed(sources: DataFrame, weights) -> DataFrame:
    """Each source with the weight of its rank, counted by ranges of names: the ranges
    are sorted in parallel, and only their sizes meet in one place."""
    key = F.encode(F.coalesce("source", F.lit("")), "UTF-8")
    parts = saved(sources.withColumn("_null", F.col("source").isNull()).withColumn("_key", key).repartitionByRange("_null", "_key").withColumn("_part", F.spark_partition_id()), "mix-ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    lead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = parts.join(sizes.select("_part", lead.alias("_lead")), "_part")
    rank = F.col("_lead") + F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_key")) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    return at.select("source", "source_size", pick.alias("w"))


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    """The rate in units of 2^-UNIT; a tilt without bound takes the cap."""
    raw = F.exp(F.least(tilt * size / mean, F.lit(math.log(cap))))
    return F.floor(F.when(tilt.isNull(), F.lit(float(cap))).otherwise(F.least(raw, F.lit(float(cap)))) * (1 << UNIT) + 0.5).cast("long")


def solve(hist: DataFrame, goals: DataFrame, cap: float = CAP, tolerance: float = 1e-6) -> DataFrame:
    """Newton's method on the dual, one tilt per source.

    hist(source, size, n): the documents' sizes, without 0; goals(source,
    source_size, target) -> source, mean, tilt (null: all documents at the cap), steps"""
    big = lambda c: c.cast("decimal(38,0)")
    docs = hist.groupBy(F.col("source").alias("_m")).agg(F.sum("n").alias("docs"))
    start = goals.where("source_size > 0").join(docs, F.col("source").eqNullSafe(F.col("_m")))
    at_cap = F.col("target") >= cap * F.col("source_size")
    start = start.select("source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), F.when(~at_cap, F.lit(0.0)).alias("tilt"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"), at_cap.alias("done"), F.lit(0).alias("steps"))
    state = saved(start, "dual")
    while state.where("not done").head(1):
        s = state.where("not done").withColumnRenamed("source", "_s")
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        free = rate < int(cap * (1 << UNIT))
        sums = (
            hist.join(s, F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s")
            .agg(F.sum(big(F.col("n") * F.col("size")) * big(rate)).alias("got"), F.sum(F.when(free, big(F.col("n") * F.col("size")) * big(F.col("size")) * big(rate))).alias("slope"))
            .select(F.col("_s").alias("_g"), (F.col("got").cast("double") / (1 << UNIT)).alias("got"), (F.col("slope").cast("double") / (1 << UNIT)).alias("slope"))
        )
        over = F.col("got") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("tilt")), F.when(over, F.col("tilt")).otherwise(F.col("hi"))
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / (F.col("slope") / F.col("mean"))
        # outside the bracket, half way; without an edge on that side, twice as far
        spread = F.when(over, F.when(F.col("nlo") < -1e8, 2 * F.col("tilt") - 1)).otherwise(F.when(F.col("nhi") > 1e8, 2 * F.col("tilt") + 1))
        step = s.join(sums, F.col("_s").eqNullSafe(F.col("_g"))).withColumn("nlo", lo).withColumn("nhi", hi)
        inside = F.coalesce((newton > F.col("nlo")) & (newton < F.col("nhi")) & (F.abs(newton - F.col("tilt")) <= 2 * F.abs("tilt") + 1), F.lit(False))
        nxt = F.when(inside, newton).otherwise(F.coalesce(spread, (F.col("nlo") + F.col("nhi")) / 2))
        near = F.abs(F.col("got") - F.col("target")) <= tolerance * F.greatest("target", F.lit(1.0))
        end = near | (F.abs(nxt - F.col("tilt")) <= 1e-13 * F.abs("tilt")) | (F.col("target") <= 0) & (F.col("got") < 0.5)
        step = step.select(F.col("_s").alias("source"), "target", "mean", F.when(end, F.col("tilt")).otherwise(nxt).alias("tilt"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), end.alias("done"), (F.col("steps") + 1).alias("steps"))
        state = saved(step.unionByName(state.where("done")), "dual", (state,))
    return state.select("source", "mean", "tilt", "steps")


def _placed(rows: DataFrame, plan: DataFrame, cap: int) -> DataFrame:
    """rows(_id, source, size) with rate, whole copies and place, from the plan's sources."""
    p = plan.withColumnRenamed("source", "_s")
    rate = F.when((F.col("size") == 0) | F.col("mean").isNull(), F.lit(0).cast("long")).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap))
    h = F.shiftrightunsigned(F.xxhash64("_id", "size", F.lit(7)), 64 - (3 * PLACE - 1))
    low = F.col("_rate").bitwiseAND((1 << UNIT) - 1)
    whole = F.shiftright("_rate", UNIT)
    # uniform hash less the fraction, moved into [0, 2^36): below the half is a copy more
    place = h + (1 << (3 * PLACE - 1)) - F.shiftleft(low, 3 * PLACE - 1 - UNIT)
    out = rows.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_rate", rate)
    return out.withColumn("_whole", whole).withColumn("_place", F.when((F.col("size") > 0) & (whole < cap), place))


def _copies(cap: int) -> Column:
    """Copies of a placed row, by its source's cut and repair."""
    more = F.when(F.col("_place") < F.col("cut"), 1).otherwise(0)
    mend = F.when((F.col("_id") == F.col("mend_id")) & (F.col("size") == F.col("mend_size")), F.col("mend_by")).otherwise(0)
    return F.greatest(F.least(F.col("_whole") + F.coalesce(more, F.lit(0)) + F.coalesce(mend, F.lit(0)), F.lit(cap)), F.lit(0)).cast("long")


def balance(base: DataFrame, weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """base(_id, source, size) -> one row per source: source, source_size, target,
    mean, tilt, steps, cut, mend_id, mend_size, mend_by. The copies of a row follow from
    its id, size and its source's row alone."""
    hist = saved(base.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    sizes = saved(hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), "mix-sizes")
    goals = saved(targets(sizes, weights, cap, share), "mix-goals")
    dual = solve(hist.where("size > 0"), goals, cap).withColumnRenamed("source", "_d")
    plan = saved(goals.join(dual, F.col("source").eqNullSafe(F.col("_d")), "left").drop("_d"), "mix-plan", (hist, sizes, goals))
    rows = saved(_placed(base, plan.select("source", "mean", "tilt"), cap).select("source", "_id", "size", "_whole", "_place"), "mix-placed")
    took = rows.groupBy(F.col("source").alias("_t")).agg(F.sum(F.col("_whole") * F.col("size")).alias("took"))
    cuts = plan.join(took, F.col("source").eqNullSafe(F.col("_t"))).select(F.col("source").alias("_s"), "target", "took", F.lit(0).cast("long").alias("cut"))
    cuts = saved(cuts, "mix-cuts")
    for shift in (2 * PLACE, PLACE, 0):
        bins = rows.where("_place is not null").join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_place", shift + PLACE) == F.col("cut")))
        bins = bins.groupBy("_s", F.shiftright("_place", shift).alias("bin")).agg(F.sum("size").alias("mass"))
        # at most 4,096 rows of a source
        upto = F.sum("mass").over(Window.partitionBy("_s").orderBy("bin"))
        sums = bins.select(F.col("_s").alias("_b"), "bin", upto.alias("upto")).join(cuts.select("_s", "took", "target"), F.col("_b").eqNullSafe(F.col("_s")))
        over = F.col("took") + F.col("upto") > F.col("target")
        heads = sums.groupBy("_b").agg(F.max(F.when(~over, F.col("upto"))).alias("taken"), F.min(F.when(over, F.col("bin"))).alias("bin"))
        step = cuts.join(heads, F.col("_s").eqNullSafe(F.col("_b")), "left")
        # the place that passes the target; beyond the last one if none does
        end = F.shiftleft(F.col("cut"), PLACE) + (1 << PLACE)
        cuts = saved(step.select("_s", "target", (F.col("took") + F.coalesce("taken", F.lit(0))).alias("took"), F.coalesce("bin", end).alias("cut")), "mix-cuts", (cuts,))
    gaps = rows.join(cuts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("gap", F.col("target") - F.col("took"))
    # rows that are alike change together; one pass over the documents that can take one more
    more = F.when(F.col("_place") >= F.col("cut"), F.col("_whole") < cap).otherwise(F.col("_whole") + 1 < cap) & F.col("_place").isNotNull()
    fits = gaps.where(more & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    pick = fits.groupBy("_s").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("d"), F.col("_id"), F.col("size"), F.col("gap"))).alias("p"))
    pick = saved(pick.select("_s", F.col("p._id").alias("mend_id"), F.col("p.size").alias("mend_size"), F.col("p.gap").alias("gap")), "mix-pick")
    same = rows.join(pick, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_id") == F.col("mend_id")) & (F.col("size") == F.col("mend_size"))).groupBy(F.col("_s").alias("_p")).agg(F.count("*").alias("alike"))
    mend = pick.join(same, F.col("_s").eqNullSafe(F.col("_p"))).where(F.abs(F.col("gap") - F.col("alike") * F.col("mend_size")) < F.abs("gap"))
    mend = mend.select(F.col("_s").alias("_p"), "mend_id", "mend_size", F.lit(1).alias("mend_by"))
    cut = cuts.select(F.col("_s").alias("_c"), "cut")
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("_c")), "left").join(mend, F.col("source").eqNullSafe(F.col("_p")), "left").drop("_c", "_p")
    return saved(out, "mix-balance", (rows, plan, cuts, pick))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """The id (a hash of the text without one), source and size of each row."""
    given = F.col(id_col).cast("long")
    return docs.select(F.coalesce(given, F.xxhash64(F.col(text_col))).alias("_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), *more)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate,
    copies, taken (= copies * size)."""
    base = saved(_base(docs, id_col, text_col, source_col, F.col(id_col).cast("long").alias("doc_id")), "mix-docs")
    plan = balance(base.drop("doc_id"), weights, cap, share)
    out = _placed(base, plan, cap).withColumn("copies", _copies(cap))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("_rate") / (1 << UNIT)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, share: float = 1.0) -> DataFrame:
    """docs as the mix takes them: each row as often as it has copies. Texts stay where
    they are: a row's copies follow from itself and its source's row of the plan."""
    base = saved(_base(docs, id_col, text_col, source_col), "mix-docs")
    plan = balance(base, weights, cap, share)
    remove(base)
    fields = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    rows = _base(docs, id_col, text_col, source_col, fields)
    taken = _placed(rows, plan, cap).withColumn("_copies", _copies(cap)).where("_copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")
