"""D: signal filters."""

from pyspark.sql import functions as F

from footfall.operators import filters as fl
from footfall.registry import fixtures as fx
from footfall.registry.base import query, r, rounded
from footfall.registry.fixtures import GRID_AXIS, sql

FRAME = "(PARTITION BY mission ORDER BY t_h ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"
CENTRED_5 = FRAME.format(a=2, b=2)


def average_sql(source, frame=CENTRED_5):
    return f"SELECT mission, i, t_h, avg(x) OVER {frame} x FROM ({source})"


def median_sql(source, frame=CENTRED_5):
    return f"SELECT mission, i, t_h, quantile_cont(x, 0.5) OVER {frame} x FROM ({source})"


def hampel_sql(source, frame=CENTRED_5, k=3.0):
    return f"""SELECT mission, i, t_h, CASE WHEN mad <> 0 AND abs(x - med) > {k!r}::DOUBLE * 1.4826::DOUBLE * mad
        THEN med ELSE x END x FROM (SELECT *, quantile_cont(abs(x - med), 0.5) OVER {frame} mad FROM (
        SELECT *, quantile_cont(x, 0.5) OVER {frame} med FROM ({source})))"""


GRID = "SELECT * FROM fx_grid"


def _registered(name, spec, source_sql):
    @query(name, sql(f"SELECT mission, i, {r('x')} FROM ({source_sql})", "fx_grid"))
    def _(spark, sf):
        return rounded(fl.apply_chain(fx.grid(spark, sf), GRID_AXIS, "x", spec), ["mission", "i"], ["x"])


_registered("D1_moving_average", {"type": "moving_average", "window": 5}, average_sql(GRID))
_registered("D1_moving_average_trailing", {"type": "moving_average", "window": 4, "center": False, "min_periods": 3},
            f"SELECT mission, i, CASE WHEN count(x) OVER {FRAME.format(a=3, b=0)} >= 3 THEN "
            f"avg(x) OVER {FRAME.format(a=3, b=0)} END x FROM fx_grid")
_registered("D2_moving_median", {"type": "moving_median", "window": 5}, median_sql(GRID))
_registered("D4_hampel", {"type": "hampel", "window": 5, "k": 3.0}, hampel_sql(GRID))
_registered("D6_filter_chain", [
    {"type": "hampel", "window": 5}, {"type": "none"}, {"type": "moving_median", "window": 5, "enabled": False},
    {"type": "moving_median", "window": 4}, {"type": "moving_average", "window": 5},
], average_sql(median_sql(hampel_sql(GRID), FRAME.format(a=2, b=1))))

EMA_SQL = """SELECT mission, i, t_h, y x FROM ema"""
EMA_ROWS = """SELECT *, row_number() OVER (PARTITION BY mission ORDER BY t_h) k FROM fx_grid"""
EMA_STEPS = """SELECT mission, i, t_h, k, x y, CASE WHEN x IS NULL THEN NULL ELSE 1.0::DOUBLE END w FROM numbered WHERE k = 1
    UNION ALL SELECT n.mission, n.i, n.t_h, n.k,
      CASE WHEN n.x IS NULL THEN e.y WHEN e.y IS NULL THEN n.x
           ELSE (e.w * 0.7::DOUBLE * e.y + 0.3::DOUBLE * n.x) / (e.w * 0.7::DOUBLE + 0.3::DOUBLE) END,
      CASE WHEN n.x IS NOT NULL THEN 1.0::DOUBLE ELSE e.w * 0.7::DOUBLE END
    FROM ema e JOIN numbered n ON n.mission = e.mission AND n.k = e.k + 1"""


# values have two decimals and alpha one, so many averages end in an exact half of the last digit; which way such a half is
# rounded is up to the order of the sums, so both sides move it off by the same small amount
OFF_HALF = 1e-9


@query("D3_exponential_average", sql(f"SELECT mission, i, round(x + {OFF_HALF!r}, 6) + 0.0 AS x FROM ({EMA_SQL})", "fx_grid", recursive=True,
                                     numbered=EMA_ROWS, ema=EMA_STEPS))
def _(spark, sf):
    smooth = fl.apply_chain(fx.grid(spark, sf), GRID_AXIS, "x", {"type": "ema", "alpha": 0.3})
    return rounded(smooth.withColumn("x", F.col("x") + OFF_HALF), ["mission", "i"], ["x"])


@query("D8_named_filter", sql(
    f"SELECT a.mission, a.i, round(a.x, 6) + 0.0 x_named, round(b.x, 6) + 0.0 x_default "
    f"FROM ({median_sql(GRID)}) a JOIN ({average_sql(GRID)}) b ON a.mission = b.mission AND a.i = b.i", "fx_grid"))
def _(spark, sf):
    table = {"default": {"type": "moving_average"}, "power": [{"type": "moving_median", "window": 5}]}
    grid = fx.grid(spark, sf)
    named = fl.filter_signal(grid, GRID_AXIS, "x", "power", table, out="x_named")
    both = fl.filter_signal(named, GRID_AXIS, "x", "speed", table, out="x_default")
    return rounded(both, ["mission", "i"], ["x_named", "x_default"])
