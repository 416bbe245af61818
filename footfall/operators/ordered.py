"""Ordered computations that never need a whole group in one task.

A recording may be arbitrarily long, so ``Window.partitionBy(mission)`` is not safe: one recording would be one task.
Every ordered operator here works on *chunks* (``floor(order / width)``) instead:

* running results (lag, last valid value, cumulative sums ...): each chunk is reduced to one summary row, the summaries
  are scanned per group (one row per chunk, so tiny), and what came before a chunk is joined back to it;
* bounded frames (``ROWS``/``RANGE`` of fixed reach): the few rows next to a chunk edge are copied to the neighbour
  chunk, so every frame is complete inside one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = "_chunk"
DEFAULT_BLOCK_ROWS = 65_536
NO_ORDER = -(1 << 63)  # chunk of the rows whose order is null


@dataclass(frozen=True)
class Axis:
    """Grouping keys, the numeric order column, the chunk width in units of that column and the tie breakers."""

    keys: tuple[str, ...]
    order: str
    width: float = 3600.0
    ties: tuple[str, ...] = ()

    def by(self, *more: str) -> "Axis":
        return Axis(self.keys + more, self.order, self.width, self.ties)

    def position(self) -> Column:
        return F.struct(F.col(self.order), *[F.col(c) for c in self.ties])

    def chunk(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(float(self.width)))

    def forward(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(self.order, *self.ties)

    def backward(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*[F.desc(c) for c in (self.order, *self.ties)])


@dataclass(frozen=True)
class Running:
    """One running column as SQL text, level by level; ``{}`` in names and texts stands for the column's own prefix.

    ``values`` are named before the rows are shuffled. ``rows`` are three levels of expressions inside a chunk, each of which
    may use the ones before it. ``ends`` are read at the last row of a chunk and are all that other chunks learn of it.
    ``chunks`` are three levels over these, with one row per chunk. ``result`` puts the columns of a row and of its chunk together.

    Windows inside a chunk: ``line`` (no frame), ``upto`` (up to the row), ``past`` (before it), ``back`` and ``back_past`` (the
    same in reverse); over the chunks of a group: ``chain`` (no frame), ``so_far``, ``before``, ``after`` and ``whole``. ``_run_k``
    numbers the rows of a chunk from 1, ``_run_end`` marks its last one, ``_run_n`` is its length, ``_run_place`` numbers chunks from 1.
    """

    result: str
    values: Mapping[str, Column] = field(default_factory=dict)
    rows: Sequence[Mapping[str, str]] = ({}, {}, {})
    ends: Mapping[str, str] = field(default_factory=dict)
    chunks: Sequence[Mapping[str, str]] = ({}, {}, {})


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _simple(value, here: str | None, end: str, carried: str, result: str, more: Mapping[str, str] | None = None) -> Running:
    """A column with one expression inside chunks and one over them."""
    rows = {**({"{}here": here} if here else {}), **(more or {})}
    return Running(result, {"{}v": _col(value)}, ({}, {}, rows), {"{}end": end}, ({}, {}, {"{}carried": carried}))


def lag(value) -> Running:
    """Value of the previous row."""
    return _simple(value, "lag({}v) OVER line", "{}v", "lag({}end) OVER chain", "CASE WHEN _run_k = 1 THEN {}carried ELSE {}here END")


def lead(value) -> Running:
    """Value of the next row."""
    return _simple(value, "lead({}v) OVER line", "{}first", "lead({}end) OVER chain", "CASE WHEN _run_end THEN {}carried ELSE {}here END",
                   {"{}first": "first_value({}v) OVER upto"})


def last_valid(value, include_current: bool = True) -> Running:
    """Latest non-null value up to this row."""
    frame = "upto" if include_current else "past"
    return _simple(value, f"last_value({{}}v) IGNORE NULLS OVER {frame}", "{}all", "last_value({}end) IGNORE NULLS OVER before",
                   "coalesce({}here, {}carried)", {"{}all": "last_value({}v) IGNORE NULLS OVER upto"})


def next_valid(value, include_current: bool = True) -> Running:
    """Earliest non-null value from this row on."""
    # reversed order keeps the frame growing at its end, which is linear work
    frame = "back" if include_current else "back_past"
    return _simple(value, f"last_value({{}}v) IGNORE NULLS OVER {frame}", "{}first", "last_value({}end) IGNORE NULLS OVER after",
                   "coalesce({}here, {}carried)", {"{}first": "first_value({}v) IGNORE NULLS OVER upto"})


def _located(value, here: str, end: str, carried: str) -> Running:
    """Position and value of a valid row: positions inside a chunk are moved by the rows of the chunks before it."""
    def moved(box: str) -> str:
        return f"CASE WHEN {box} IS NOT NULL THEN named_struct('p', {box}.p + coalesce({{}}base, 0), 'v', {box}.v) END"

    box = "CASE WHEN {}v IS NOT NULL THEN named_struct('p', CAST(_run_k AS BIGINT) - 1, 'v', {}v) END"
    return Running(f"coalesce({moved('{}here')}, {{}}carried)", {"{}v": _col(value)}, ({}, {"{}box": box}, {"{}here": here, "{}all": end}),
                   {"{}end": "{}all"}, ({"{}base": "sum(_run_n) OVER before"}, {"{}moved": moved("{}end")}, {"{}carried": carried}))


def last_valid_at(value) -> Running:
    """(p, v): 0-based position and value of the latest row up to this one that has a value."""
    upto = "last_value({}box) IGNORE NULLS OVER upto"
    return _located(value, upto, upto, "last_value({}moved) IGNORE NULLS OVER before")


def next_valid_at(value) -> Running:
    """(p, v): 0-based position and value of the earliest row from this one on that has a value."""
    return _located(value, "last_value({}box) IGNORE NULLS OVER back", "first_value({}box) IGNORE NULLS OVER upto",
                    "last_value({}moved) IGNORE NULLS OVER after")


def running_sum(value) -> Running:
    return _simple(value, "sum({}v) OVER upto", "{}here", "sum({}end) OVER before", "coalesce({}carried + {}here, {}here, {}carried)")


def running_max(value, include_current: bool = True) -> Running:
    frame = "upto" if include_current else "past"
    return _simple(value, f"max({{}}v) OVER {frame}", "{}all", "max({}end) OVER before", "greatest({}here, {}carried)", {"{}all": "max({}v) OVER upto"})


def remaining_min(value) -> Running:
    """Smallest value from this row on."""
    return _simple(value, "min({}v) OVER back", "{}all", "min({}end) OVER after", "least({}here, {}carried)", {"{}all": "min({}v) OVER upto"})


def row_index() -> Running:
    """0-based position of the row in its group."""
    return Running("coalesce({}carried, 0) + _run_k - 1", chunks=({}, {}, {"{}carried": "sum(_run_n) OVER before"}))


Name = Callable[[str], str]


def pairwise(step: Callable[[Name, Name], str], start: str, columns: Mapping[str, Column | str], total: bool = False) -> Running:
    """A function of each row and the one before it, or (``total``) its running sum, in which nulls count as nothing.

    ``step(here, prev)`` writes the function as SQL: ``here("x")`` and ``prev("x")`` name the value of ``columns["x"]`` in the two
    rows. ``start`` is its value at the first row of a group. Steps inside a chunk need that chunk alone, and the step between
    two chunks needs the last row of one and the first of the other, so a sum of differences takes one shuffle and not two.
    """
    here, prev, first, ahead = (lambda c, k=k: f"{{}}{k}_{c}" for k in ("v", "p", "f", "b"))
    rows = ({prev(c): f"lag({here(c)}) OVER line" for c in columns}, {"{}step": f"CASE WHEN _run_k > 1 THEN {step(here, prev)} END"},
            {first(c): f"first_value({here(c)}) OVER upto" for c in columns} | ({"{}here": "sum({}step) OVER upto"} if total else {}))
    ends = {f"{{}}first_{c}": first(c) for c in columns} | {f"{{}}last_{c}": here(c) for c in columns} | ({"{}sum": "{}here"} if total else {})
    border = f"CASE WHEN _run_place > 1 THEN {step(lambda c: f'{{}}first_{c}', ahead)} ELSE {start} END"
    sums = {"{}carried": "coalesce(sum({}sum) OVER before, 0) + coalesce(sum({}border) OVER so_far, 0)"} if total else {}
    return Running("coalesce({}here, 0) + {}carried" if total else "CASE WHEN _run_k = 1 THEN {}border ELSE {}step END",
                   {here(c): _col(v) for c, v in columns.items()}, rows, ends,
                   ({ahead(c): f"lag({{}}last_{c}) OVER chain" for c in columns}, {"{}border": border}, sums))


def group_first(value, valid_only: bool = False) -> Running:
    """Value of the first row of the group (or its first non-null value)."""
    nulls = "IGNORE NULLS " if valid_only else ""
    return _simple(value, None, "{}first", f"first_value({{}}end) {nulls}OVER whole", "{}carried", {"{}first": f"first_value({{}}v) {nulls}OVER upto"})


def group_last(value) -> Running:
    return _simple(value, None, "{}v", "last_value({}end) OVER whole", "{}carried")


def group_max(value) -> Running:
    return _simple(value, "max({}v) OVER upto", "{}here", "max({}end) OVER whole", "{}carried")


def group_min(value) -> Running:
    return _simple(value, "min({}v) OVER upto", "{}here", "min({}end) OVER whole", "{}carried")


def group_count(value=None) -> Running:
    return _simple(F.lit(1) if value is None else value, "count({}v) OVER upto", "{}here", "sum({}end) OVER whole", "{}carried")


def _select(source: str, columns: Mapping[str, str], windows: str = "") -> str:
    """The source with further columns."""
    return f"(SELECT *{''.join(f', {text} AS `{name}`' for name, text in columns.items())} FROM {source} {windows})" if columns else source


def _never_null(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns that tell groups apart and are never null: joins on them need no filter, which would make exchanges differ."""
    def filled(key: str) -> Column:
        kind = df.schema[key].dataType
        if isinstance(kind, (T.StringType, T.NumericType, T.BooleanType)):
            return F.coalesce(F.col(key), F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind))
        return F.struct(key)

    flags = [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)]
    return {**{f"_run_g{i}": filled(k) for i, k in enumerate(keys)}, "_run_nulls": sum(flags, F.lit(0))}


def running(df: DataFrame, axis: Axis, **specs: Running) -> DataFrame:
    """Add running columns. The input is read once and its rows are shuffled once, by (keys, chunk).

    What a chunk passes on is read at its last row, in the windows that also give the row results. These few rows are scanned
    per group and joined back. Rows are shuffled packed in an array of one struct, which column pruning does not look into: both
    branches then ask for the same exchange, and Spark reuses it. So choose the rows and columns to keep before the call. Null
    keys are a group, rows without order come first.
    """
    def put(texts: Sequence[Mapping[str, str]]) -> dict[str, str]:
        return {k.replace("{}", p): v.replace("{}", p) for p, m in zip(prefixes, texts, strict=True) for k, v in m.items()}

    prefixes, given = [f"_{k}_" for k in range(len(specs))], list(specs.values())
    values = {k.replace("{}", p): v for p, s in zip(prefixes, given, strict=True) for k, v in s.values.items()}
    groups = _never_null(df, axis.keys)
    packed = F.array(F.struct(*df.columns, *[v.alias(k) for k, v in values.items()]))
    chunk = F.coalesce(axis.chunk(), F.lit(NO_ORDER))
    chunked = df.select(*[c.alias(k) for k, c in groups.items()], chunk.alias(CHUNK), packed.alias("_packed")).repartition(*groups, CHUNK)
    order = [f"`{c}`" for c in (axis.order, *axis.ties)]
    forth, by = ", ".join(order), ", ".join(groups)
    back = ", ".join(f"{c} DESC" for c in order)
    upto, past = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def windows(group: str, **named: str) -> str:
        return "WINDOW " + ", ".join(f"{n} AS (PARTITION BY {group} ORDER BY {w})" for n, w in named.items())

    inside = windows(f"{by}, {CHUNK}", line=forth, upto=f"{forth} {upto}", past=f"{forth} {past}", back=f"{back} {upto}", back_past=f"{back} {past}")
    over = windows(by, chain=CHUNK, so_far=f"{CHUNK} {upto}", before=f"{CHUNK} {past}", after=f"{CHUNK} DESC {past}",
                   whole=f"{CHUNK} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    levels = [put([s.rows[k] for s in given]) for k in range(3)]
    levels[0] = {"_run_k": "row_number() OVER line", "_run_end": "lead(1) OVER line IS NULL", **levels[0]}
    rows = f"(SELECT {by}, {CHUNK}, _row.* FROM (SELECT {by}, {CHUNK}, element_at(_packed, 1) AS _row FROM {{chunked}}))"
    for level in levels:
        rows = _select(rows, level, inside)
    ends = ", ".join(f"{text} AS `{name}`" for name, text in {"_run_n": "_run_k", **put([s.ends for s in given])}.items())
    chunks, learned = f"(SELECT {by}, {CHUNK}, {ends} FROM {rows} WHERE _run_end)", {}
    for k in range(3):
        level = put([s.chunks[k] for s in given])
        learned |= level
        chunks = _select(chunks, {**({"_run_place": "row_number() OVER chain"} if k == 0 else {}), **level}, over)
    chunks = f"(SELECT {', '.join([by, CHUNK, *learned])} FROM {chunks})"
    out = {n: s.result.replace("{}", p) for (n, s), p in zip(specs.items(), prefixes, strict=True)}
    kept = [f"`{c}`" for c in df.columns if c not in out]
    return df.sparkSession.sql(
        f"SELECT {', '.join([*kept, *[f'{text} AS `{n}`' for n, text in out.items()]])} "
        f"FROM {rows} LEFT JOIN {chunks} USING ({by}, {CHUNK})", chunked=chunked)


def positions(df: DataFrame, axis: Axis, name: str = "_pos") -> DataFrame:
    """0-based row position per group, computed from chunk counts."""
    return running(df, axis, **{name: row_index()})


def with_halo(df: DataFrame, order: Column, width: float, before: float, after: float) -> DataFrame:
    """Copy rows near a chunk edge to the chunks whose frames reach them; ``_core`` marks the row's own chunk."""
    w = F.lit(float(width))
    first = F.floor((order - F.lit(float(after))) / w)
    last = F.floor((order + F.lit(float(before))) / w)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col(CHUNK) == F.floor(order / w)
    )


def framed(
    df: DataFrame,
    axis: Axis,
    before: int,
    after: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    pos: str | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """Run ``build`` where every ROWS frame reaching ``before``/``after`` rows is complete.

    ``pos`` names an existing dense row position (a uniform clock has one); otherwise positions are counted first.
    """
    source = df if pos else positions(df, axis)
    position = pos or "_pos"
    block = max(block_rows or DEFAULT_BLOCK_ROWS, before + after + 1)
    haloed = with_halo(source, F.col(position), block, before, after)
    window = Window.partitionBy(*axis.keys, CHUNK).orderBy(position)
    built = build(haloed, window).where("_core")
    drop = [CHUNK, "_core"] + ([] if pos else ["_pos"])
    return built.drop(*drop)


def ranged(
    df: DataFrame,
    axis: Axis,
    before: float,
    after: float,
    build: Callable[[DataFrame, Callable[[float, float], str]], DataFrame],
) -> DataFrame:
    """Run ``build`` where every RANGE frame reaching ``before``/``after`` units of the order column is complete.

    ``build`` gets a function that writes the OVER clause of such a frame (frames of fractional reach need SQL text).
    """
    slack = 1e-6 + 1e-9 * max(before, after)
    haloed = with_halo(df, F.col(axis.order), max(axis.width, before + after), before + slack, after + slack)
    groups = ", ".join(f"`{c}`" for c in (*axis.keys, CHUNK))

    def over(back: float, ahead: float) -> str:
        return (f"OVER (PARTITION BY {groups} ORDER BY `{axis.order}` "
                f"RANGE BETWEEN {float(back)!r}D PRECEDING AND {float(ahead)!r}D FOLLOWING)")

    return build(haloed, over).where("_core").drop(CHUNK, "_core")
