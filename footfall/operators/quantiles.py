"""Exact group quantiles without gathering a group.

``percentile`` keeps every distinct value of a group in one task. Here a sketch first brackets each wanted rank; a bracket
that would still hold too many values is narrowed by a sketch of its own values, again and again. One pass then counts what lies
below each bracket and keeps only the values inside it, and a running count over those picks the exact neighbours of the rank,
linearly interpolated. Each pick is checked: a rank that its bracket missed is looked for on the side where it must be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.session import materialize

ACCURACY = 10_000
# ten times the sketch's guaranteed rank error on either side
MARGIN = 10.0 / ACCURACY
#: Values of one bracket that one task may order, and steps of the sketch that narrows larger ones.
INSIDE, STEPS = 2_000_000, 500


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: Sequence[float],
              names: Sequence[str]) -> DataFrame:
    """One row per group: ``names[i]`` = exact ``probs[i]`` quantile of the non-null values, linear interpolation."""
    v = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    data = df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    for k in keys:
        data = data.where(F.col(k).isNotNull())
    wanted, found = _first_brackets(data, keys, probs), None
    while True:
        small = (F.col("_size") <= INSIDE) | (F.col("_lo") >= F.col("_hi"))
        large = wanted.where(~small).withColumns({"_hit": F.lit(False), "_q": F.lit(None).cast("double")})
        tried = materialize(_picked(data, keys, wanted.where(small)).unionByName(large))
        hits = tried.where("_hit").select(*keys, "_slot", "_q")
        found = hits if found is None else found.unionByName(hits)
        missed = tried.where("NOT _hit").select(*keys, "_slot", "_rank", "_lo", "_hi", "_size")
        if missed.isEmpty():
            break
        wanted = _narrowed(data, keys, missed)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_slot") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def _first_brackets(data: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, slot, rank, lo, hi, size): an expected bracket of each rank, and about how many values it holds."""
    low, high = ([min(max(p + m, 0.0), 1.0) for p in probs] for m in (-MARGIN, MARGIN))
    sketched = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", low, ACCURACY).alias("_los"), F.percentile_approx("_v", high, ACCURACY).alias("_his"))
    slots = F.array(*[
        F.struct(F.lit(i).alias("_slot"), ((F.col("_n") - 1) * F.lit(float(p))).alias("_rank"), F.element_at("_los", i + 1).alias("_lo"),
                 F.element_at("_his", i + 1).alias("_hi"), (F.col("_n") * 2 * MARGIN).alias("_size"))
        for i, p in enumerate(probs)])
    return sketched.where("_n > 0").select(*keys, F.inline(slots))


def _joined(data: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Every value with the brackets of its group."""
    if keys:
        return data.join(wanted, keys)
    # without keys there are as many brackets as wanted quantiles
    return data.crossJoin(F.broadcast(wanted))


def _narrowed(data: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Narrow the brackets that hold more than ``INSIDE`` values, until none does. Brackets of one value need no narrowing."""
    while True:
        wide = wanted.where((F.col("_size") > INSIDE) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            return wanted
        inside = F.when((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")), F.col("_v"))
        grid = [k / STEPS for k in range(STEPS + 1)]
        seen = _joined(data, keys, wide).groupBy(*keys, "_slot", "_rank", "_lo", "_hi", "_size").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count(inside).alias("_n"), F.percentile_approx(inside, grid, ACCURACY).alias("_grid"))
        at = (F.col("_rank") - F.col("_below")) / F.greatest(F.col("_n") - 1, F.lit(1)) * STEPS
        low = F.greatest(F.least(F.floor(at) - 1, F.lit(STEPS)), F.lit(0)).cast("int")
        high = F.greatest(F.least(F.ceil(at) + 1, F.lit(STEPS)), F.lit(0)).cast("int")
        closer = seen.select(*keys, "_slot", "_rank", F.get("_grid", low).alias("_to"), F.get("_grid", high).alias("_hi2"), "_lo", "_hi", "_n", (high - low).alias("_steps"))
        closer = closer.select(*keys, "_slot", "_rank", F.col("_to").alias("_lo2"), "_hi2", "_lo", "_hi", (F.col("_n") * F.col("_steps") / STEPS).alias("_size"))
        # a bracket that cannot shrink holds hardly anything but one value: it is counted, not listed
        stuck = (F.col("_lo2") <= F.col("_lo")) & (F.col("_hi2") >= F.col("_hi"))
        closer = closer.select(*keys, "_slot", "_rank", F.col("_lo2").alias("_lo"), F.col("_hi2").alias("_hi"), F.when(stuck, 0.0).otherwise(F.col("_size")).alias("_size"))
        wanted = materialize(wanted.where((F.col("_size") <= INSIDE) | (F.col("_lo") >= F.col("_hi"))).unionByName(closer))


def _picked(data: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, slot, rank, hit, q, lo, hi, size): the value at each rank, or the side of the bracket where it must be looked for.

    What lies outside the bracket collapses into two partial rows per (group, rank) before the shuffle, equal values into one.
    These two rows keep the value next to the bracket, which is a neighbour the rank may need, and the one farthest from it.
    """
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    sided = _joined(data, keys, wanted).select(*keys, "_slot", "_rank", "_v", side.alias("_side"))
    counted = sided.groupBy(*keys, "_slot", "_rank", "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_inside")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    near = F.when(F.col("_side") > 0, F.col("_least")).otherwise(F.col("_most"))
    counted = counted.withColumn("_value", near)
    upto = Window.partitionBy(*keys, "_slot").orderBy("_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_cum", F.sum("_c").over(upto))
    floor, ceil = F.floor("_rank"), F.ceil("_rank")
    # positions known exactly: all inside, the last one below, the first one above
    known_from = F.when(F.col("_side") < 0, F.col("_cum") - 1).otherwise(F.col("_cum") - F.col("_c"))
    known_to = F.when(F.col("_side") > 0, F.col("_cum") - F.col("_c")).otherwise(F.col("_cum") - 1)

    def at(position: Column) -> Column:
        return F.max(F.when((known_from <= position) & (position <= known_to), F.col("_value")))

    def outside(sign: int, value: Column) -> Column:
        return F.max(F.when(F.col("_side") == sign, value))

    picked = ranked.groupBy(*keys, "_slot", "_rank").agg(
        at(floor).alias("_a"), at(ceil).alias("_b"), F.coalesce(outside(-1, F.col("_c")), F.lit(0)).alias("_below"), outside(-1, F.col("_least")).alias("_first"),
        outside(-1, F.col("_most")).alias("_last_below"), outside(1, F.col("_least")).alias("_first_above"), outside(1, F.col("_most")).alias("_last"),
        F.coalesce(outside(1, F.col("_c")), F.lit(0)).alias("_above"))
    lower = floor < F.col("_below")
    # a rank between two sides is looked for from the lower neighbour on
    return picked.select(
        *keys, "_slot", "_rank", (F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_hit"),
        (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - floor)).alias("_q"),
        F.when(lower, F.col("_first")).otherwise(F.col("_first_above")).alias("_lo"), F.when(lower, F.col("_last_below")).otherwise(F.col("_last")).alias("_hi"),
        F.when(lower, F.col("_below")).otherwise(F.col("_above")).cast("double").alias("_size"))
