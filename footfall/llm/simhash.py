"""Near duplicates by 64-bit fingerprints of word shingles, found with pivot distance tables."""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from footfall.llm.common import bound_batches, stored
from footfall.llm.components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Shingles hashed at a time, so that a very long text needs no more memory than others.
BLOCK = 1 << 15
BLOCKS = 4
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit number; 0 for a text without words."""
    # lower() changes A-Z only, split() cuts at 0x20 and 0x09-0x0D only
    words = text.lower().split()
    n = max(len(words) - SHINGLE + 1, min(len(words), 1))
    if n == 0:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at:at + BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter(map(_hash, shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def references(families: int, seed: int = 7) -> tuple[list[int], list[int], dict[tuple[int, int], int]]:
    """Random reference fingerprints, the masks of the blocks, and each reference with one block complemented."""
    rng = np.random.default_rng(seed)
    width = 64 // BLOCKS
    masks = [((1 << width) - 1) << (width * b) for b in range(BLOCKS)]
    pivots = [int(x) for x in rng.integers(0, 1 << 64, families, dtype=np.uint64)]
    return pivots, masks, {(j, b): p ^ m for j, p in enumerate(pivots) for b, m in enumerate(masks)}


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference)).cast("long")))


def near_pairs(prints: DataFrame, families: int = 8, bucket_limit: int = 100) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that connect all fingerprints at MOST_BITS or fewer differing bits.

    The distance table holds, for each fingerprint, its Hamming distances to random references and to the same references
    with one 16-bit block complemented. Half the difference of two such distances is the distance inside the block, equal
    for two fingerprints that agree there. Two fingerprints at 2 bits agree in two of four blocks, so pairs are sought only
    among equal table entries of two blocks. Of these, pairs with a coordinate difference above MOST_BITS to any reference
    are discarded and the rest are verified. No link is lost.

    Buckets with more than ``bucket_limit`` fingerprints would make many pairs. Their fingerprints are linked another exact
    way: all within one bit of a common value are within two bits of each other, and at most 65 fingerprints share such a value.
    """
    pivots, masks, turned = references(families)
    width = 64 // BLOCKS
    fp = F.col("fp")
    near = [_distance(fp, p).cast("byte").alias(f"d{j}") for j, p in enumerate(pivots)]
    entry = []
    for b in range(BLOCKS):
        inside = [((F.col(f"d{j}") - _distance(fp, turned[j, b]) + width) / 2).cast("long") * (width + 1) ** j for j in range(families)]
        entry.append(sum(inside[1:], inside[0]).alias(f"block{b}"))
    coordinates = [f"d{j}" for j in range(families)]
    tables = prints.select("fp", *near).select("fp", *coordinates, *entry)
    keys = F.array(*[F.struct(F.lit(k).alias("blocks"), F.col(f"block{x}").alias("x"), F.col(f"block{y}").alias("y"))
                     for k, (x, y) in enumerate(combinations(range(BLOCKS), 2))])
    spread = stored(tables.select("fp", *coordinates, F.explode(keys).alias("key")).select("fp", *coordinates, "key.*"), "distances")
    key = ["blocks", "x", "y"]
    counts = stored(spread.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = spread.join(counts.filter(F.col("n") <= bucket_limit).drop("n"), key, "left_semi")
    left = shared.select(*key, F.col("fp").alias("a"), *[F.col(c).alias(f"a_{c}") for c in coordinates])
    right = shared.select(*key, F.col("fp").alias("b"), *[F.col(c).alias(f"b_{c}") for c in coordinates])
    widest = F.greatest(*[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in coordinates])
    pairs = left.join(right, key).filter((F.col("a") < F.col("b")) & (widest <= MOST_BITS)
                                         & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)).select("a", "b")
    full = spread.join(counts.filter(F.col("n") > bucket_limit).drop("n"), key, "left_semi").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    around = full.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    met = around.groupBy("value").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("others")).filter(F.size("others") > 1)
    met = met.select("a", F.explode("others").alias("b")).filter("a != b")
    return pairs.union(met).distinct()


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of all fingerprints of ``rows`` (id, fp)."""
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(near_pairs(nodes.select("fp")))
    linked = stored(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    moved = linked.join(least, "root").select("fp", "component_id", "root")
    return stored(nodes.join(moved, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the least id reachable over links.

    Null and wordless texts have fingerprint zero and link like any other. Equal fingerprints are one node from here on, so
    copies are never expanded to pairs. A document without an id takes its component from the ids it is linked with (null if
    none). Repeated rows give repeated results; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col(id_column).cast("long").alias("id"), _fingerprint(text).alias("fp")), "fingerprints")
    return rows.join(_classes(rows), "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the least id (null ids last), of repeated rows the first."""
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
                              _fingerprint(text).alias("fp"), F.struct(*docs.columns).alias("doc")), "fingerprints")
    roots = _classes(rows.select("id", "fp")).select("fp", "root")
    # first the best row of each fingerprint, then of each component, so that no group comes together
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best")
    prints = stored(rows.groupBy("fp").agg(best), "best")
    stay = prints.join(roots, "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.row")
    # both sides are shuffled at every size: the rows that stay grow with the input and are never broadcast
    return rows.join(stored(stay, "stay").hint("merge"), "row", "left_semi").select("doc.*")
