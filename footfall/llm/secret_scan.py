"""Secret scan: base patterns, and random strings told from ordinary identifiers by two character Markov models. DataFrame functions only."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import running_sums, stored

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns (fixed values) and the least lengths of their matches (of the value, for an assignment).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
LEAST_VALUE = 6
# a match of the shorter forms that is long enough is a match of these, as runs are always taken whole
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Strings that the models judge: runs of so many characters of keys and encodings.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Log-likelihood ratio from which a run counts as random: in all, and for each step.
LEAST_RATIO, LEAST_STEP = 8.0, 0.3
CODES = 128
#: Steps that the back-off weighs as much as: a character seen a few times says little about what follows it.
BACK_OFF = 64.0


def _matches(text: Column, pattern: str, hint: Column, group: int = 0) -> Column:
    """(start, stop, value) of the leftmost non-overlapping matches, in characters; ``hint``: whether there can be any."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # what splitting leaves between the matches gives their places
    lengths = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("length")))

    def placed(x: Column) -> Column:
        before = running_sums(F.transform(x, lambda l: l["gap"] + l["length"]))
        return F.zip_with(before, x, lambda at, l: F.struct((at + l["gap"]).alias("start"), (at + l["gap"] + l["length"]).alias("stop")))

    spans = F.zip_with(_bound(F.slice(lengths, F.lit(1), F.size(found)), placed), values,
                       lambda p, v: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), v.alias("value")))
    return F.when(hint, spans).otherwise(F.expr("cast(array() as array<struct<start: int, stop: int, value: string>>)"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often (or inside of which loop) the body reads it."""
    return F.transform(F.array(value), body)[0]


def _meets(spans: Column, run: Column) -> Column:
    """Whether a run overlaps one of ``spans``, which are in order and apart: the last one that starts before its end decides.

    It is found by halving, so that a text costs its matches times the logarithm of their number.
    """
    last = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda at, step: F.when(
        (step <= F.size(spans) - at) & (F.try_element_at(spans, at + step)["start"] < run["stop"]), at + step).otherwise(at))
    return (F.size(spans) > 0) & _bound(last, lambda at: (at > 0) & (F.try_element_at(spans, F.greatest(at, F.lit(1)))["stop"] > run["start"]))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["value"].alias("value")))


def find_spans(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``base`` spans (start, kind, stop, value) and ``runs`` outside of them (start, stop, value).

    Columns of ``docs`` named so are replaced. The work on a text is about linear in its length, also where all of it matches.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, text.rlike(ASSIGN_HINT), 2), lambda s: F.length(s["value"]) >= LEAST_VALUE)
    access = _matches(text, ACCESS, text.contains("AKIA"))
    hexes = _matches(text, HEX, text.rlike(HEX))
    runs = _matches(text, RUN, text.rlike(RUN))
    found = _bound(F.struct(assign.alias("assign"), access.alias("access"), hexes.alias("hex"), runs.alias("runs")), lambda m: F.struct(
        F.array_sort(F.concat(*[_of_kind(m[k], i) for i, k in enumerate(KINDS[:3])])).alias("base"),
        F.filter(m["runs"], lambda r: ~(_meets(m["assign"], r) | _meets(m["access"], r) | _meets(m["hex"], r))).alias("runs")))
    kept = F.struct(*[F.col(c) for c in docs.columns if c not in (text_column, "base", "runs")])
    return docs.select(kept.alias("kept"), found.alias("found")).select("kept.*", "found.base", "found.runs")


def _steps(value: Column) -> Column:
    """One number for each pair of neighbouring characters; characters beyond ASCII share code 0."""
    codes = F.transform(F.split(value, ""), lambda c: F.when(F.ascii(c) < CODES, F.ascii(c)).otherwise(F.lit(0)))
    n = F.greatest(F.length(value) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, F.lit(1), n), F.slice(codes, F.lit(2), n), lambda a, b: a * CODES + b)


def train(found: DataFrame, labelled: DataFrame | None = None) -> list[float] | None:
    """Log ratios of all character steps, random against ordinary, from all rows of ``find_spans``, or from ``labelled``.

    ``labelled`` has ``value`` (a string) and ``random`` (whether it is a key); rows with a null in either are left out. Without it,
    samples labelled random are the values of base spans, those labelled ordinary the runs outside of them. What reaches the
    driver is a count for each step and label, bounded by the alphabet. None if one label has no sample.
    """
    if labelled is None:
        random = found.select(F.explode("base.value").alias("value"), F.lit(True).alias("random"))
        labelled = random.union(found.select(F.explode("runs.value").alias("value"), F.lit(False).alias("random")))
    labelled = labelled.filter("value is not null and random is not null")
    steps = labelled.select("random", F.explode(_steps(F.col("value"))).alias("step"))
    counts: dict[bool, dict[int, int]] = {True: {}, False: {}}
    for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect():
        counts[r["random"]][r["step"]] = r["n"]
    if not counts[True] or not counts[False]:
        return None

    def model(of: dict[int, int]) -> Callable[[int, int], float]:
        # each step backs off to how common its second character is, that to any of the 65 characters of keys
        second, after = [0.0] * CODES, [0.0] * CODES
        for step, n in of.items():
            after[step // CODES] += n
            second[step % CODES] += n
        total = sum(second)
        share = [(n + 1.0) / (total + 65.0) for n in second]
        return lambda a, b: math.log((of.get(a * CODES + b, 0) + BACK_OFF * share[b]) / (after[a] + BACK_OFF))

    is_random, is_ordinary = model(counts[True]), model(counts[False])
    return [round(is_random(a, b) - is_ordinary(a, b), 4) for a in range(CODES) for b in range(CODES)]


def judge(found: DataFrame, ratios: list[float] | None) -> DataFrame:
    """Add the random ones among ``runs`` to ``base`` as ``spans``."""
    if ratios is None:
        return found.withColumn("spans", F.col("base")).drop("runs")
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    ratio = F.transform("runs", lambda r: F.struct(r.alias("run"), F.aggregate(
        _steps(r["value"]), F.lit(0.0), lambda s, step: s + F.element_at(table, step + 1)).alias("ratio")))
    random = F.filter(ratio, lambda x: (x["ratio"] >= LEAST_RATIO) & (x["ratio"] >= LEAST_STEP * (F.length(x["run"]["value"]) - 1)))
    added = _of_kind(F.transform(random, lambda x: x["run"]), 3)
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("runs")


def scan(docs: DataFrame, text_column: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """``docs`` without the text, with its secrets: ``base`` and ``spans``, both by start, then kind.

    Models are trained on ``labelled`` (see ``train``) or on all documents given. Columns named base, runs or spans are replaced. A null text is an empty one; texts without a match have empty lists; every row
    is scanned on its own, so repeated rows and null ids do no harm; an empty table gives an empty result.
    """
    found = stored(find_spans(docs, text_column), "spans")
    return judge(found, train(found, labelled))


def as_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    counts = [F.size(F.expr(f"filter(base, s -> s.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return scan(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
