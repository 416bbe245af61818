"""Soft-membership mixing: domain posteriors from a classifier of labelled rows, then rates that bring expected domain tokens to targets. DataFrame functions only."""

from __future__ import annotations

import json
import logging
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.common import sampling_hash, stored

#: Hash buckets of words, and the words that the back-off of all buckets of a domain weighs as much as.
BUCKETS, BACK_OFF = 1 << 13, 8192.0
#: Labelled rows that the classifier is fitted on, about, and the share of them held back to calibrate it.
SAMPLE, HELD_BACK = 20_000, 0.2
#: What calibration tries: standard errors by which a bucket must be more or less common in a domain than in all to count there;
#: the evidence of n words is multiplied by factor / n ^ power.
ERRORS = [0.0, 2.0, 4.0, 6.0]
FACTORS, POWERS = [2.0 ** (k / 2) for k in range(-12, 13)], [0.0, 0.25, 0.5, 0.75, 1.0]
#: The miss of a target (share of all tokens) that is good enough, and the change of the rates that counts as none.
TOLERANCE, FLAT = 1e-3, 1e-6
#: Weight that steadies the moments; steps after which the rates are stored; passes after which a fit is given up, with a warning.
STEADY, STORED, PASSES = 1e-6, 8, 200

#: For each domain: log prior, log ratio of each bucket to its usual share, (factor, power) of the evidence.
Model = dict[str, tuple[float, list[float], tuple[float, float]]]


def buckets(text: Column) -> Column:
    """Hash buckets, from 1, of the words of a text, which white space parts; a null or empty text has none."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int") + 1)


def train(labelled: DataFrame, label: str, text_column: str = "text") -> Model:
    """Naive Bayes over word buckets, calibrated.

    All rows with a label count; what reaches the driver is one count for each domain and bucket. Domains are few and known.
    A bucket counts once a text. Words of a text are no independent witnesses, and most say nothing of a domain, so both the weight
    of the evidence and what counts as evidence are those that fit best (least log loss) the labels of a share of the rows,
    chosen by a hash of the text, on which no counts are taken.
    """
    rows = labelled.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("domain"), F.array_distinct(buckets(F.col(text_column))).alias("b"), (sampling_hash(F.col(text_column)) < HELD_BACK).alias("held"))
    priors = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    counts = {d: [0] * BUCKETS for d in priors}
    seen = rows.filter("not held").select("domain", F.explode("b").alias("b"))
    for r in seen.groupBy("domain", "b").agg(F.count("*").alias("n")).collect():
        counts[r["domain"]][r["b"] - 1] = r["n"]
    every = [sum(c) + 1.0 for c in zip(*counts.values(), strict=True)] if counts else []
    total = sum(every)

    def model(errors: float, scale: tuple[float, float]) -> Model:
        found = {}
        for d, own in counts.items():
            size = sum(own)
            logs = []
            for n, e in zip(own, every, strict=True):
                # counts back off to how common a bucket is over all domains
                usual = e / total * size
                odd = abs(n - usual) > errors * math.sqrt(usual)
                logs.append(round(math.log((n + BACK_OFF * e / total) / (usual + BACK_OFF * e / total)), 3) if odd else 0.0)
            found[d] = (math.log(priors[d] / sum(priors.values())), logs, scale)
        return found

    held = stored(rows.filter("held"), "held_back")
    _, errors, scale = min((loss, e, scale) for e in ERRORS for loss, scale in [_calibrated(held, model(e, (1.0, 1.0)))])
    return model(errors, scale)


def _calibrated(held: DataFrame, model: Model) -> tuple[float, tuple[float, float]]:
    """The least log loss over ``held`` (domain, b) and its factor and power; (1, 1), the mean evidence of a word, without rows."""
    if not model:
        return 0.0, (1.0, 1.0)
    names = sorted(model)
    parts = held.withColumnRenamed("b", "_b").select(F.array_position(F.array(*map(F.lit, names)), F.col("domain")).cast("int").alias("own"),
                        F.size("_b").alias("n"), F.array(*[_evidence(_table(model[d][1])) for d in names]).alias("logs"))
    grid = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(w).alias("power")) for f in FACTORS for w in POWERS])
    tried = parts.select("own", "n", "logs", F.explode(grid).alias("g"))
    scale = F.col("g.factor") / F.pow(F.greatest(F.col("n"), F.lit(1)).cast("double"), F.col("g.power"))
    priors = F.array(*[F.lit(model[d][0]) for d in names])
    tried = tried.select("own", "g", F.zip_with("logs", priors, lambda x, prior: x * scale + prior).alias("x"))
    top = F.array_max("x")
    loss = top + F.log(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("x")))) - F.element_at("x", F.col("own"))
    best = tried.groupBy("g").agg(F.sum(loss).alias("loss")).collect()
    return min(((round(r["loss"], 6), (r["g"]["factor"], r["g"]["power"])) for r in best), default=(0.0, (1.0, 1.0)))


def memberships(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` without the text, with ``tokens`` (words) and ``p`` (posteriors in the order of the sorted domains)."""
    rows = docs.withColumn("_b", buckets(F.col(text_column))).drop(text_column).withColumn("tokens", F.size("_b").cast("long"))
    rows = rows.withColumn("_b", F.array_distinct("_b"))
    logs = []
    for d in sorted(model):
        prior, values, (factor, power) = model[d]
        weaker = F.lit(factor) / F.pow(F.greatest(F.size("_b"), F.lit(1)).cast("double"), F.lit(power))
        logs.append(F.lit(prior) + _evidence(_table(values)) * weaker)
    rows = rows.withColumn("_log", F.array(*logs) if logs else F.expr("cast(array() as array<double>)"))
    rows = rows.withColumn("_e", F.transform("_log", lambda x: F.exp(x - F.array_max("_log"))))
    whole = F.aggregate("_e", F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("p", F.transform("_e", lambda x: x / whole)).drop("_b", "_log", "_e")


def _table(values: list[float]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def _evidence(values: Column) -> Column:
    return F.aggregate("_b", F.lit(0.0), lambda s, b: s + F.element_at(values, b))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small positive system, by elimination; a trace of the diagonal is added, as domains may coincide."""
    n = len(right)
    trace = 1e-9 * sum(matrix[i][i] for i in range(n)) + 1e-12
    rows = [[*(v + (trace if i == j else 0.0) for j, v in enumerate(row)), right[i]] for i, row in enumerate(matrix)]
    for i in range(n):
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for j in range(n):
            if j != i:
                rows[j] = [v - rows[j][i] * w for v, w in zip(rows[j], rows[i], strict=True)]
    return [row[n] for row in rows]


def _held(value: Column, least: float, most: float | None) -> Column:
    held = F.greatest(F.lit(float(least)), value)
    return held if most is None else F.least(F.lit(float(most)), held)


def _moved(now: Column, p: list[Column], step: list[float], least: float, most: float | None) -> Column:
    """The rate after a step against the gradient, projected onto the limits."""
    return _held(now - reduce(lambda a, b: a + b, [x * F.lit(v) for x, v in zip(p, step, strict=True)]), least, most)


def rate(p: Column, steps: list[list[float]], least: float, most: float | None = None) -> Column:
    """The rate that the steps of a descent lead to from one: it depends on the memberships alone."""
    return reduce(lambda r, step: _moved(r, [F.element_at(p, i + 1) for i in range(len(step))], step, least, most), steps, F.lit(1.0))


def descend(members: DataFrame, domains: list[str], targets: dict[str, float], least: float = 0.0, most: float | None = None,
            grow: bool = False) -> list[list[float]]:
    """The steps from rates of one to the least-squares fit of the rates of ``members`` (tokens, p) to the targets, by projected
    gradient: what is made small is the sum of the squared misses of the domains' expected token totals.

    ``targets`` are shares of all tokens of the result; they are scaled to sum to one over the ``domains`` that have tokens.
    The result has as many tokens as the input, or, with ``grow``, as many as it takes that no domain shrinks. Rates are at
    least ``least`` (0 or more) and, if given, at most ``most``. A step moves every rate by p times the misses, scaled by the
    inverse moments of the rows that the limits leave free to move, and is halved while it does not lower the misses. The fit
    ends at the tolerance or where the projected gradient no longer moves the rates; targets that cannot be met are then missed
    as little as they can, with a warning. A pass is one sum over the table; rates are stored with their rows after every
    ``STORED`` steps, and the driver sees a few numbers for each domain.
    """
    k = range(len(domains))
    p = [F.element_at("p", i + 1) for i in k]
    if not domains or not sum(max(targets.get(d, 0.0), 0.0) for d in domains):
        return []
    tokens = F.col("tokens")
    first = members.agg(F.sum("tokens").alias("t"), *[F.sum(tokens * p[i]).alias(f"s{i}") for i in k], *[F.sum(tokens * p[i] * p[i]).alias(f"m{i}") for i in k]).first()
    own = [first[f"s{i}"] or 0.0 for i in k]
    total = sum(own)
    wanted = [max(targets.get(d, 0.0), 0.0) if own[i] > 0 else 0.0 for i, d in enumerate(domains)]
    if not total or not sum(wanted):
        return []
    wanted = [w / sum(wanted) for w in wanted]
    size = max([total, *(own[i] / w for i, w in enumerate(wanted) if w)]) if grow else total
    goal = [w * size for w in wanted]
    steady = STEADY * sum(first[f"m{i}"] for i in k)

    def fits(miss: list[float]) -> bool:
        return max(map(abs, miss)) <= TOLERANCE * size

    rows = members.select("tokens", "p", F.lit(1.0).alias("rate"))
    steps, since, passes = [], [], 1
    miss = [own[i] - goal[i] for i in k]
    values = [sum(m * m for m in miss)]
    flat = False
    while not fits(miss) and not flat and passes < PASSES:
        if len(since) == STORED:
            rows, since = stored(rows.withColumn("rate", reduce(lambda r, s: _moved(r, p, s, least, most), since, F.col("rate"))), "rates"), []
        now = reduce(lambda r, s: _moved(r, p, s, least, most), since, F.col("rate"))
        pull = reduce(lambda a, b: a + b, [p[i] * F.lit(miss[i]) for i in k])
        free = (now > least) | (pull < 0)
        if most is not None:
            free &= (now < most) | (pull > 0)
        weight = tokens * free.cast("double")
        moments = rows.agg(*[F.sum(weight * p[i] * p[j]).alias(f"m{i}_{j}") for i in k for j in k if i <= j]).first()
        passes += 1
        matrix = [[moments[f"m{min(i, j)}_{max(i, j)}"] + (steady if i == j else 0.0) for j in k] for i in k]
        direction, length = _solved(matrix, miss), 1.0
        while passes < PASSES:
            step = [length * v for v in direction]
            then = _moved(now, p, step, least, most)
            got = rows.agg(F.sum(tokens * (then - now) * (then - now)).alias("change"), *[F.sum(tokens * p[i] * then).alias(f"s{i}") for i in k]).first()
            passes += 1
            found = [got[f"s{i}"] - goal[i] for i in k]
            value = sum(m * m for m in found)
            if math.sqrt(got["change"] / first["t"]) < FLAT * length:
                flat = True
                break
            # the latest few values are the bar, so that a step may rise a little on its way along a bend
            if value < max(values[-5:]) * (1 - 1e-9):
                steps.append(step)
                since.append(step)
                miss = found
                values.append(value)
                break
            length /= 2
    if not fits(miss):
        reached = {d: round((goal[i] + miss[i]) / size, 4) for i, d in enumerate(domains)}
        logging.getLogger(__name__).warning("targets %s are not met, tokens reached are %s", targets, reached)
    return steps


def reached(rated: DataFrame, domains: list[str]) -> dict[str, float]:
    """Shares of the expected tokens of each domain under the rates of ``mix``; none where there are no tokens."""
    sums = rated.agg(*[F.sum(F.col("tokens") * F.element_at("p", i + 1) * F.col("rate")) for i in range(len(domains))]).first() if domains else []
    total = sum(v or 0.0 for v in sums)
    return {d: (v or 0.0) / total for d, v in zip(domains, sums, strict=True)} if total else {}


def domain(quality: Column, toxic: Column) -> Column:
    """The domain of a labelled document: toxic, low (quality) or high; null where the marks say nothing."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "high")


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """Documents that ``labels`` marks, with their domain; of several marks of one document the worst counts.

    About ``sample_rows`` of them, chosen by a hash of the id: their ids are few enough to send to every task, so that no text
    is shuffled for the classifier.
    """
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"), F.max("toxic").alias("_toxic"))
    drawn = marks.filter(sampling_hash(F.col("doc_id")) < min(1.0, sample_rows / max(marks.count(), 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return stored(rows.select("text", domain(F.col("_quality"), F.col("_toxic")).alias("domain")), "labelled")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, most: float | None = None,
        grow: bool = False, keep: bool = False) -> tuple[DataFrame, list[str]]:
    """``docs`` without the text, with tokens, p and rate, and the domains in the order of ``p``.

    With ``keep`` the rows are stored with their memberships, so that texts are classified once; it is for rows that are small
    without the text column. Otherwise only memberships are stored, and texts are classified again for the result.
    Null texts have no tokens and the prior as membership; without labelled rows every rate is one and ``p`` is empty;
    repeated rows are rated alike; an empty table gives an empty result. Columns named like the new ones are replaced.
    """
    model = train(labelled.filter(F.col("domain").isin(list(targets))), "domain")
    names = sorted(model)
    rows = memberships(docs, model)
    members = stored(rows if keep else rows.select("tokens", "p"), "members")
    steps = descend(members, names, targets, least, most, grow)
    return (members if keep else rows).withColumn("rate", rate(F.col("p"), steps, least, most)), names


def copies(rate: Column, *key: Column) -> Column:
    """A whole number of copies, 0 or more, whose mean is the rate: its fraction is decided by a hash of the row."""
    return (F.floor(rate) + (sampling_hash(*key) < rate - F.floor(rate)).cast("int")).cast("int")
