"""Orientation between two frames of a moving robot, composed from a stream of timestamped transforms.

A transform table has one row per update: ``mission, is_static, t, parent, child, qw, qx, qy, qz`` (+ tie breakers).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import quaternions as qf
from footfall.operators import ordered as o
from footfall.operators.alignment import asof_join
from footfall.operators.ordered import Axis
from footfall.session import materialize

# fixed values: worlds tried after the configured ones, and the one that is also looked for through the IMU
DEFAULT_WORLDS = ("map", "odom", "enu_origin")
RETRIED_WORLD = "enu_origin"
Q = ("qw", "qx", "qy", "qz")
# fixed values: two orientations closer than this are the same one
ABSOLUTE_TOLERANCE = 1e-6
RELATIVE_TOLERANCE = 1e-5


def world_candidates(world: str | None, fallbacks: Sequence[str] = ()) -> list[str]:
    """Configured world frame, fallbacks, then the usual names; without repeats."""
    frames = [(w or "").lstrip("/") for w in (world, *fallbacks, *DEFAULT_WORLDS)]
    return list(dict.fromkeys(f for f in frames if f))


class ShortestPaths:
    """Shortest undirected paths from some frames to all others, kept up to date while edges are added.

    Among equally short paths the alphabetically first one counts. An edge only touches frames that it brings nearer, or to which
    it leads by an earlier name, so an edge that changes nothing costs two comparisons a world.
    """

    def __init__(self, worlds: Sequence[str]):
        self.neighbours: dict[str, set[str]] = {}
        self.best: list[dict[str, tuple[int, tuple[str, ...]]]] = [{} for _ in worlds]
        self.worlds = list(worlds)

    def add(self, a: str, b: str) -> None:
        fresh = [f for f in (a, b) if f not in self.neighbours]
        self.neighbours.setdefault(a, set()).add(b)
        self.neighbours.setdefault(b, set()).add(a)
        for world, best in zip(self.worlds, self.best, strict=True):
            if world in fresh:
                best[world] = (1, (world,))
            waiting = deque(f for f in (a, b) if f in best)
            while waiting:
                frame = waiting.popleft()
                length, path = best[frame]
                for other in sorted(self.neighbours[frame]):
                    candidate = (length + 1, (*path, other))
                    if other not in best or candidate < best[other]:
                        best[other] = candidate
                        waiting.append(other)

    def first(self, frame: str) -> tuple[int, tuple[str, ...]] | None:
        """(rank, path) of the first world that reaches a frame."""
        for rank, best in enumerate(self.best):
            if frame in best:
                return rank, best[frame][1]
        return None


HOPS = "array<struct<slot: int, reversed: boolean>>"


def _walk_histories(worlds: Sequence[str], base: str):
    """For each order in which edges first appear: the path that holds from every edge on, its hops as numbers of used edges."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for history in batch["history"]:
                edges = [(e["parent"], e["child"]) for e in history]
                paths, seen, slots, epochs = ShortestPaths(worlds), set(), {}, []
                for edge in edges:
                    paths.add(*edge)
                    seen.add(edge)
                    found, hops = paths.first(base), None
                    if found is not None:
                        hops = []
                        for a, b in zip(found[1][:-1], found[1][1:], strict=True):
                            stored = (a, b) if (a, b) in seen else (b, a)  # a stored direction wins over its reverse
                            hops.append((slots.setdefault(stored, len(slots)), stored != (a, b)))
                    epochs.append((edge, found, hops))
                for (parent, child), found, hops in epochs:
                    out.append((history, parent, child, slots.get((parent, child)), None if found is None else found[0],
                                None if hops is None else [{"slot": k, "reversed": r} for k, r in hops]))
            yield pd.DataFrame(out, columns=["history", "parent", "child", "slot", "rank", "hops"]).astype({"slot": "Int32", "rank": "Int32"})

    return walk


def path_epochs(transforms: DataFrame, worlds: Sequence[str], base: str, axis: Axis) -> DataFrame:
    """Per recording and edge: ``first_at`` (its first update by ``axis``), and what holds from then until the next new edge.

    ``rank`` and ``hops`` are the first candidate world that the edges seen so far connect with ``base``, and the hops of the
    shortest path; both are null while there is none. A hop names the ``slot`` of its edge, and whether it is walked backwards.
    The graph of a recording has as many edges as its robot has joints between frames, however long it is. Recordings whose
    edges appear in the same order share one walk.
    """
    keys = list(axis.keys)
    firsts = transforms.groupBy(*keys, "parent", "child").agg(F.min(axis.position()).alias("first_at"))
    order = F.array_sort(F.collect_list(F.struct("first_at", "parent", "child")))
    histories = firsts.groupBy(*keys).agg(F.transform(order, lambda e: F.struct(e["parent"].alias("parent"), e["child"].alias("child"))).alias("history"))
    walked = histories.select("history").distinct().mapInPandas(
        _walk_histories(worlds, base), "history array<struct<parent: string, child: string>>, parent string, child string, slot int, rank int, hops " + HOPS)
    return firsts.join(histories.join(walked, "history").drop("history"), [*keys, "parent", "child"])


def compose_orientation(transforms: DataFrame, worlds: Sequence[str], base: str, axis: Axis) -> DataFrame:
    """World-to-base orientation at every transform update from which a path exists.

    ``axis`` orders the updates of one recording. Static transforms come before all others. At each update the path is the
    shortest one over the edges seen so far, from the first candidate world that has one; every hop takes its latest update.
    """
    keys = list(axis.keys)
    # statics are placed one chunk before the first update, keeping their own order among themselves
    starts = transforms.groupBy(*keys).agg(F.min(axis.order).alias("_start"), F.max(axis.order).alias("_end"))
    placed = transforms.join(starts, keys).withColumn(
        "_when", F.when(F.col("is_static"), F.col(axis.order) - (F.col("_end") - F.col("_start")) - axis.width)
        .otherwise(F.col(axis.order))).drop("_start", "_end")
    line = Axis(axis.keys, "_when", axis.width, axis.ties)
    epochs = materialize(path_epochs(placed, worlds, base, line))
    most = epochs.agg(F.max("slot").alias("slots"), F.max(F.size("hops")).alias("hops")).first()
    q, hops = F.struct(*Q), F.col("hops")
    tagged = placed.join(epochs.drop("rank", "hops"), [*keys, "parent", "child"])
    # the row at which an edge appears first carries the path that holds from there
    starting = epochs.where(hops.isNotNull()).select(*keys, "parent", "child", F.struct("rank", "hops").alias("_epoch"))
    tagged = tagged.join(starting, [*keys, "parent", "child"], "left")
    begins = F.when(line.position() == F.col("first_at"), F.col("_epoch"))
    slots = 0 if most["slots"] is None else most["slots"] + 1
    seen = o.running(tagged, line, _path=o.last_valid(begins), **{f"_s{k}": o.last_valid(F.when(F.col("slot") == k, q)) for k in range(slots)})
    latest = F.array(*[F.col(f"_s{k}") for k in range(slots)])
    total = qf.constant((1.0, 0.0, 0.0, 0.0))
    for k in range(most["hops"] or 0):
        hop = F.get(F.col("_path.hops"), F.lit(k))
        edge = F.get(latest, hop["slot"])
        forth = tuple(edge[c] for c in Q)
        turned = tuple(F.when(hop["reversed"], back).otherwise(ahead) for back, ahead in zip(qf.conjugate(forth), forth, strict=True))
        product = F.struct(*[c.alias(n) for n, c in zip(Q, qf.multiply(total, turned), strict=True)])
        so_far = F.struct(*[c.alias(n) for n, c in zip(Q, total, strict=True)])
        seen = seen.withColumn("_total", F.when(hop.isNull(), so_far).otherwise(product))
        total = tuple(F.col(f"_total.{n}") for n in Q)
    unit = qf.canonical(qf.normalize(total))
    return seen.where(F.col("_path").isNotNull()).select(
        *keys, axis.order, *axis.ties, "_when", "is_static", F.col("_path.rank").alias("world_rank"), *[c.alias(n) for c, n in zip(unit, Q, strict=True)])


def _differs(rows: np.ndarray, last: np.ndarray) -> np.ndarray:
    limit = ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE * np.abs(last)
    return (np.abs(rows - last) > limit).any(axis=1) & (np.abs(rows + last) > limit).any(axis=1)


def thin_changes(orientations: DataFrame, axis: Axis, order: str = "_when") -> DataFrame:
    """Keep an orientation only when it differs from the last kept one (q and -q are the same); a static update only
    while nothing was kept.

    A row that moved more than twice the tolerance from its predecessor differs from whatever was kept last, so it is
    kept for certain. Those rows cut a recording into short runs that are thinned independently, each streamed in order.
    """
    return _thinned(materialize(orientations), axis, order)


def _thinned(rows: DataFrame, axis: Axis, order: str = "_when") -> DataFrame:
    keys = list(axis.keys)
    line = Axis(axis.keys, order, axis.width, axis.ties)
    first = rows.groupBy(*keys).agg(F.min(line.position()).alias("_first"))
    rows = rows.join(first, keys).where(~F.col("is_static") | (line.position() == F.col("_first"))).drop("_first")
    limit = 2.5 * (ABSOLUTE_TOLERANCE + RELATIVE_TOLERANCE)

    def moved(here, prev) -> str:
        far = [" OR ".join(f"abs({here(c)} {sign} {prev(c)}) > {limit!r}D" for c in Q) for sign in "-+"]
        return f"CASE WHEN ({far[0]}) AND ({far[1]}) THEN 1 ELSE 0 END"

    quaternion = {c: c for c in Q}
    rows = o.running(rows, line, _sure=o.pairwise(moved, "1", quaternion), _run=o.pairwise(moved, "1", quaternion, total=True),
                     **{f"_n{c}": o.lead(c) for c in Q})
    ends = F.col("_nqw").isNull() | (F.expr(moved(lambda c: f"_n{c}", lambda c: c)) == 1)
    # runs of one row need no second look
    alone = (F.col("_sure") == 1) & ends
    rows = rows.withColumn("_alone", alone).drop("_sure", *[f"_n{c}" for c in Q])
    single, longer = rows.where("_alone").drop("_alone", "_run"), rows.where("NOT _alone").drop("_alone")
    columns = single.columns
    streamed = longer.repartition(*keys, "_run").sortWithinPartitions(*keys, "_run", order, *axis.ties)
    kept = streamed.mapInPandas(_thin_runs(keys), streamed.schema).select(*columns)
    return single.unionByName(kept)


def _thin_runs(keys: Sequence[str], first_look: int = 64):
    """Thin sorted runs: from the last kept row on, look for the next one that differs, in stretches that double."""

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, None
        for batch in batches:
            values = batch[list(Q)].to_numpy(dtype=float)
            ids = batch[[*keys, "_run"]]
            edges = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy())
            keep = np.zeros(len(batch), dtype=bool)
            for start, stop in zip(edges, [*edges[1:], len(batch)]):
                rid, at, look = tuple(ids.iloc[start]), start, first_look
                if rid != run:
                    run, last, keep[start] = rid, values[start], True
                    at = start + 1
                while at < stop:
                    hits = np.flatnonzero(_differs(values[at:min(at + look, stop)], last))
                    if len(hits):
                        at += int(hits[0])
                        last, keep[at], look = values[at], True, first_look
                        at += 1
                    else:
                        at, look = at + look, look * 2
            yield batch[keep]

    return thin


def orientation_table(transforms: DataFrame, axis: Axis, base: str, world: str, fallbacks: Sequence[str] = (),
                      imu_frame: str | None = None, imu_to_base: Sequence[float] | None = None,
                      odom: DataFrame | None = None) -> DataFrame:
    """One orientation series per recording, with a ``*_map`` block where the wanted world was not reached.

    ``source_rank``: 0 = the wanted world (or its fallbacks) to base; 1 = the wanted world reached through the IMU frame
    and turned by its mounting, the fallback series becoming the map block; 2 = ``odom`` (mission, t, qw..qz) for
    recordings without any transform path. The IMU frame is tried only where ``RETRIED_WORLD`` was asked for and another world
    served last, and taken only if the wanted world serves last there.
    """
    keys, t = list(axis.keys), axis.order
    worlds = world_candidates(world, fallbacks)
    composed = materialize(compose_orientation(transforms, worlds, base, axis))
    reached = composed.groupBy(*keys).agg(F.max_by("world_rank", F.struct("_when", *axis.ties)).alias("_reached"))
    primary = materialize(_thinned(composed, axis).select(*keys, t, *Q))
    missed = reached.where(F.col("_reached") > 0)
    series = primary.withColumn("source_rank", F.lit(0))
    with_map = reached.limit(0)
    if imu_frame and worlds[0] == RETRIED_WORLD:
        around = compose_orientation(transforms.join(missed, keys, "left_semi"), world_candidates(world), imu_frame, axis)
        around = materialize(around)
        served = around.groupBy(*keys).agg(F.max_by("world_rank", F.struct("_when", *axis.ties)).alias("_last")).where("_last = 0")
        around = _thinned(around.join(served, keys, "left_semi"), axis)
        turned = qf.quat() if imu_to_base is None else qf.apply_offset(qf.quat(), qf.constant(imu_to_base))
        around = around.select(*keys, t, *[c.alias(n) for c, n in zip(turned, Q)], F.lit(1).alias("source_rank"))
        around = materialize(around)
        series = around.unionByName(series.join(around.select(*keys).distinct(), keys, "left_anti"))
        with_map = missed
    if odom is not None:
        spare = odom.select(*keys, t, *Q, F.lit(2).alias("source_rank"))
        series = series.unionByName(spare.join(reached, keys, "left_anti"))
    aside = primary.join(with_map, keys, "left_semi").groupBy(*keys, t).agg(
        F.max_by(F.struct(*Q), F.struct(*Q)).alias("_q")).select(*keys, t, "_q.*")
    return asof_join(series, aside, Axis(axis.keys, t, axis.width), "nearest", None, {c: f"{c}_map" for c in Q})
