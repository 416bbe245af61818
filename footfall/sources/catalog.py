"""The mission catalog: resolution, folders, naming, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PREFIX = 5  # fixed value: letters of a usable given prefix
DERIVED_PREFIX = 4  # fixed value: letters kept of a derived prefix
DEFAULT_PREFIX = "MISS"  # fixed value


def resolve(requested: DataFrame, aliases: DataFrame, missions: DataFrame) -> DataFrame:
    """Keys (alias or id) to catalog entries; ``id`` is null where a key is unknown. The display name is the alias used,
    else the id's first alias, else its name, else its folder."""
    used = requested.join(aliases.select(F.col("alias").alias("key"), F.col("id").alias("_via")), "key", "left")
    first = aliases.groupBy("id").agg(F.min_by("alias", F.struct("pos", "alias")).alias("_first_alias"))
    named = used.withColumn("id", F.coalesce("_via", "key")).join(missions, "id", "left").join(first, "id", "left")
    known = F.col("folder").isNotNull()
    display = F.coalesce(F.when(F.col("_via").isNotNull(), F.col("key")), "_first_alias", "name", "folder")
    return named.select("key", F.when(known, F.col("id")).alias("id"), "folder", F.when(known, display).alias("display"))


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("id IS NULL").select("key")


def requested_missions(lines: DataFrame, aliases: DataFrame, missions: DataFrame) -> DataFrame:
    """Listed keys without blanks and # comments, resolved, one row per id keeping the first; ``lines``: pos, line.
    A list without keys asks for every mission, all at position 0."""
    text = F.trim("line")
    wanted = lines.select("pos", text.alias("key")).where((text != "") & ~text.startswith("#"))
    if wanted.isEmpty():
        wanted = missions.select(F.lit(0).alias("pos"), F.col("id").alias("key"))
    found = resolve(wanted.select("key").distinct(), aliases, missions).where("id IS NOT NULL")
    placed = wanted.join(found, "key")
    return placed.groupBy("id").agg(F.min_by(F.struct("key", "folder", "display"), "pos").alias("_f"), F.min("pos").alias("pos")
                                    ).select("id", "pos", "_f.*")


def assign_folders(missions: DataFrame, given: str = "folder") -> DataFrame:
    """Existing folder, else the id's first segment, else the whole id when another mission owns that segment."""
    short = F.split_part(F.col("id"), F.lit("-"), F.lit(1))
    owners = missions.where(F.col(given).isNotNull()).groupBy(F.col(given).alias("_short")).agg(F.min("id").alias("_owner"))
    fresh = missions.withColumn("_short", short)
    claims = fresh.where(F.col(given).isNull()).groupBy("_short").agg(F.min("id").alias("_first"))
    joined = fresh.join(owners, "_short", "left").join(claims, "_short", "left")
    free = F.col("_owner").isNull() & (F.col("_first") == F.col("id"))
    return joined.withColumn("folder", F.coalesce(F.col(given), F.when(free, F.col("_short")), F.col("id"))).select(
        *dict.fromkeys([*missions.columns, "folder"]))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New values override old ones where given; ids of both sides stay."""
    columns = [c for c in old.columns if c != "id"]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(
        F.coalesce("n.id", "o.id").alias("id"), *[
            (F.coalesce(f"n.{c}", f"o.{c}") if c in new.columns else F.col(f"o.{c}")).alias(c) for c in columns])


def split_name(df: DataFrame) -> DataFrame:
    """``prefix`` and ``number`` wanted for each id from ``short`` (preferred) or ``label``."""
    short = F.upper(F.replace(F.trim("short"), F.lit("_"), F.lit("-")))
    given = r"^(\p{L}+)-?(\d+)?$"
    usable = short.rlike(given) & (F.length(F.regexp_extract(short, given, 1)) <= MAX_PREFIX)
    trimmed = F.regexp_replace(F.coalesce("label", F.lit("")), r"^[0-9_]+", "")
    token = F.regexp_extract(trimmed, r"^([^_]+)", 1)
    parts = r"^(\p{L}+)(\d+)?"
    letters = F.when(token.rlike(parts), F.upper(F.regexp_extract(token, parts, 1))).otherwise(F.upper(token))
    derived = F.substring(letters, 1, DERIVED_PREFIX)
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).cast("bigint")
    return df.withColumns({
        "prefix": F.when(usable, F.regexp_extract(short, given, 1)).when(derived != "", derived).otherwise(DEFAULT_PREFIX),
        "number": F.when(usable, number(short, given)).otherwise(F.when(token.rlike(parts), number(token, parts))),
    })


def _numbers_given(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """(prefix, number) of all names that are given in the end: the same set in whatever order the ids are served.

    Free numbers are counted from the gaps between used ones, so no list of numbers is built. One row per catalog entry.
    """
    claims = wanted.where("number IS NOT NULL").join(taken, ["prefix", "number"], "left_anti")
    won = claims.groupBy("prefix", "number").agg(F.min("id").alias("id"))
    rest = wanted.join(won.select("id"), "id", "left_anti").select("id", "prefix", F.greatest(F.coalesce("number", F.lit(1)), F.lit(1)).alias("number"))
    used = taken.select("prefix", "number").unionByName(won.select("prefix", "number")).distinct().where("number >= 1")
    by_number = Window.partitionBy("prefix").orderBy("number")
    # rank, among the free numbers, of the first one at or after the wanted number
    upto = Window.partitionBy("prefix").orderBy("number", "_used").rowsBetween(Window.unboundedPreceding, 0)
    sorted_in = rest.withColumn("_used", F.lit(0)).unionByName(used.withColumn("_used", F.lit(1)), allowMissingColumns=True)
    ranked = sorted_in.withColumn("_rank", F.col("number") - F.sum("_used").over(upto)).where("_used = 0")
    # served in order, each at least one after the one before: k + running max of (rank - k)
    order = Window.partitionBy("prefix").orderBy("number", "id")
    queue = ranked.withColumn("_k", F.row_number().over(order)).withColumn(
        "_place", F.col("_k") + F.max(F.col("_rank") - F.col("_k")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # before the k-th used number u there are u - k free ones
    gaps = used.select("prefix", "number", (F.col("number") - F.row_number().over(by_number)).alias("_free"))
    merged = queue.select("prefix", "id", F.col("_place").alias("_at"), F.lit(1).alias("_q")).unionByName(
        gaps.select("prefix", F.lit(None).cast("bigint").alias("id"), (F.col("_free") + 1).alias("_at"), F.lit(0).alias("_q")))
    # the n-th free number is n plus the used numbers that have fewer than n free ones before them
    seen = Window.partitionBy("prefix").orderBy("_at", "_q").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("number", F.col("_at") + F.sum(1 - F.col("_q")).over(seen)).where("_q = 1")
    return won.select("prefix", "number").unionByName(placed.select("prefix", "number"))


def _serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of runs of neighbouring numbers, taken ones first and then claims by id: each claim gets the next free number from its own on."""
    run, after = None, {}

    def free(n: int) -> int:
        seen = []
        while n in after:
            seen.append(n)
            n = after[n]
        for m in seen:  # next time straight there
            after[m] = n
        return n

    for batch in batches:
        numbers = []
        for prefix, k, claim, start in zip(batch["prefix"], batch["_run"], batch["_claim"], batch["start"], strict=True):
            if (prefix, k) != run:
                run, after = (prefix, k), {}
            n = free(int(start)) if claim else int(start)
            after[n] = n + 1
            numbers.append(n)
        yield batch.assign(number=numbers)[batch["_claim"] == 1][["id", "prefix", "number"]]


def assign_short_names(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """Unique ``PREFIX-number`` names. Ids are served in order, each getting the first free number from the one it wants on (from 1
    where it wants none). ``wanted``: id, prefix, number; ``taken``: prefix, number of other ids.

    Which numbers are given does not depend on the order, only who gets them does. So the numbers in use form runs without a
    gap, a claim is served inside the run that holds its wanted number, and runs are served in parallel, row by row.
    """
    used = taken.select("prefix", "number").unionByName(_numbers_given(wanted, taken)).distinct()
    runs = used.withColumn("_run", F.col("number") - F.row_number().over(Window.partitionBy("prefix").orderBy("number")))
    claims = wanted.select("id", "prefix", F.coalesce("number", F.lit(1)).cast("bigint").alias("number"), F.lit(1).alias("_claim"))
    given = taken.select(F.lit(None).cast(wanted.schema["id"].dataType).alias("id"), "prefix", F.col("number").cast("bigint").alias("number"), F.lit(0).alias("_claim")).distinct()
    rows = given.unionByName(claims).join(runs, ["prefix", "number"]).withColumnRenamed("number", "start")
    ordered = rows.repartition("prefix", "_run").sortWithinPartitions("prefix", "_run", "_claim", "id")
    schema = T.StructType([wanted.schema["id"], wanted.schema["prefix"], T.StructField("number", T.LongType())])
    served = ordered.mapInPandas(_serve, schema)
    return served.withColumn("short_name", F.concat("prefix", F.lit("-"), F.col("number").cast("string")))


def export_entries(fresh: DataFrame, existing: DataFrame, contains: str | None = None, limit: int | None = None) -> DataFrame:
    """Filter by substring, named first, then by name and id, optional top-n; merged over the existing entries."""
    chosen = fresh if contains is None else fresh.where(F.col("name").contains(contains))
    if limit:
        chosen = chosen.orderBy(F.col("name").isNull(), "name", "id").limit(limit)
    return upsert(existing, chosen)
