"""Choosing tables, files, rasters and topics by ranked rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: tokens that identify a topic of each kind when no configured name matches
TOPIC_TOKENS = {
    "cmd_vel": ("twist", "cmd"),
    "odom": ("odom", "state_estimator"),
    "gps": ("navsatfix", "gnss"),
    "imu": ("imu",),
    "anymal_state": ("anymal_state", "state_estimator"),
}
TWIN_ENDINGS = {".bag": ".mcap", ".mcap": ".bag"}  # fixed values: both formats of a recording
HZ_PATTERN = r"synced_(\d+)Hz"  # fixed value


def hz_of(name: Column) -> Column:
    found = F.regexp_extract(name, HZ_PATTERN, 1)
    return F.when(found != "", found.cast("int"))


def select_synced(files: DataFrame, keys: Sequence[str], hz: int | None = None, prefer_metrics: bool = False,
                  metrics_only: bool = False) -> DataFrame:
    """One file per group: the preferred kind (plain or metrics) of the wanted rate, newest first, then by name."""
    is_metrics = F.col("name").endswith("_metrics.parquet")
    named = files.withColumns({"hz": hz_of(F.col("name")), "is_metrics": is_metrics}).where(F.col("hz").isNotNull())
    if hz is not None:
        named = named.where(F.col("hz") == hz)
    if metrics_only:
        named = named.where("is_metrics")
    rank = F.when(F.col("is_metrics") == F.lit(prefer_metrics), 0).otherwise(1)
    best = F.min_by(F.struct("name", "hz", "is_metrics", "mtime"), F.struct(rank, -F.col("mtime"), F.col("name")))
    return named.groupBy(*keys).agg(best.alias("_f")).select(*keys, "_f.*")


def glob_regex(pattern: str) -> str:
    """Shell wildcards (*, ? and [..]) as an anchored regular expression."""

    def part(token: str) -> str:
        if len(token) > 1:
            negated = token.startswith("[!")
            inside = re.sub(r"([\\\[\]^&])", r"\\\1", token[1 + negated:-1])
            return f"[{'^' if negated else ''}{inside}]"
        return {"*": ".*", "?": "."}.get(token) or re.escape(token)

    return "^" + "".join(part(t) for t in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.DOTALL)) + "$"


def _matches(topic: Column, pattern: str) -> Column:
    if any(c in pattern for c in "*?["):
        return topic.rlike(glob_regex(pattern))
    return topic.endswith(pattern)


def choose_topics(topics: DataFrame, candidates: Mapping[str, Sequence[str]],
                  tokens: Mapping[str, Sequence[str]] = TOPIC_TOKENS) -> DataFrame:
    """Per recording and key the best topic: candidates in order (wildcard, exact before suffix), else a topic holding one
    of the key's tokens; equal rank goes to the first topic by name. Candidate lists are configuration, hence plan constants."""
    topic = F.col("topic")
    options = []
    for key, wanted in candidates.items():
        rank = None
        for k, pattern in enumerate(wanted):
            hit, exact = _matches(topic, pattern), topic == pattern
            place = F.when(exact, 2 * k).otherwise(2 * k + 1)
            rank = F.when(hit, place) if rank is None else rank.when(hit, place)
        fallback = F.lit(False)
        for token in tokens.get(key, ()):
            fallback = fallback | F.lower(topic).contains(token)
        last = F.when(fallback, F.lit(2 * len(wanted)))
        options.append(F.struct(F.lit(key).alias("key"), (last if rank is None else F.coalesce(rank, last)).alias("rank")))
    ranked = topics.select("mission", "topic", F.inline(F.array(*options))).where(F.col("rank").isNotNull())
    return ranked.groupBy("mission", "key").agg(F.min_by("topic", F.struct("rank", "topic")).alias("topic"))


def expand_patterns(patterns: Sequence[str]) -> list[str]:
    """Each pattern, its twin in the other format, then both for numbered splits (``name*``); duplicates go, order stays."""
    out = []
    for p in patterns:
        endings = next(([end, twin] for end, twin in TWIN_ENDINGS.items() if p.endswith(end)), None)
        if endings is None:
            out += [p, *[p.replace(end, twin) for end, twin in TWIN_ENDINGS.items() if end in p]]
            continue
        stem = p.removesuffix(endings[0])
        stems = [stem] if stem.endswith("*") else [stem, f"{stem}*"]
        out += [f"{s}{end}" for s in stems for end in endings]
    return list(dict.fromkeys(out))


def match_patterns(files: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """Files with the first pattern (by rank) that fits them."""
    fits = F.coalesce(*[F.when(F.col(name).rlike(glob_regex(p)), F.lit(k)) for k, p in enumerate(patterns)])
    return files.withColumn("pattern_rank", fits).where(F.col("pattern_rank").isNotNull())


def pattern_presence(files: DataFrame, patterns: Sequence[str], name: str = "name") -> DataFrame:
    """For each pattern whether any file matches it, in one pass over the files."""
    hits = files.agg(*[F.bool_or(F.col(name).rlike(glob_regex(p))).alias(f"p{k}") for k, p in enumerate(patterns)])
    return hits.select(F.inline(F.array(*[
        F.struct(F.lit(p).alias("pattern"), F.coalesce(F.col(f"p{k}"), F.lit(False)).alias("present"))
        for k, p in enumerate(patterns)])))


def choose_rasters(files: DataFrame, keys: Sequence[str], patterns: Sequence[str], explicit: str | None = None,
                   sidecar: Column | None = None, name: str = "name") -> DataFrame:
    """Raster per recording: the explicit one, else the one its sidecar names, else by pattern order and name."""
    rank = F.coalesce(*[F.when(F.col(name).rlike(glob_regex(p)), F.lit(k + 2)) for k, p in enumerate(patterns)])
    if sidecar is not None:
        rank = F.when(sidecar == F.col(name), 1).otherwise(rank)
    if explicit is not None:
        rank = F.when(F.col(name) == explicit, 0).otherwise(rank)
    ranked = files.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    return ranked.groupBy(*keys).agg(F.min_by(name, F.struct("_rank", name)).alias(name))


def latest_file(files: DataFrame, keys: Sequence[str], name: str = "name", mtime: str = "mtime") -> DataFrame:
    return files.groupBy(*keys).agg(F.max_by(name, F.struct(mtime, name)).alias(name))


def gps_gate(missions: DataFrame, gps: DataFrame) -> DataFrame:
    """Flag recordings that have any position."""
    located = gps.where("lat IS NOT NULL AND lon IS NOT NULL").select("mission").distinct().withColumn("_gps", F.lit(True))
    return missions.join(located, "mission", "left").withColumn("has_gps", F.coalesce("_gps", F.lit(False))).drop("_gps")
