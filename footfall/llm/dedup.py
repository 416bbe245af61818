"""Exact deduplication against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from footfall.llm.common import bound_batches, stored


@F.pandas_udf(StringType())
def _digest(texts: pd.Series) -> pd.Series:
    # lower() of bytes changes A-Z only
    return pd.Series([hashlib.sha256(b.lower()).hexdigest() for b in texts], dtype="str")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", whole: bool = False) -> DataFrame:
    """(row, id, digest) of every row, and all its columns as ``doc`` if ``whole``; a null text counts as the empty text.

    Stored, so that ``row`` stays what it is.
    """
    bound_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    doc = [F.struct(*docs.columns).alias("doc")] if whole else []
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
                              _digest(text).alias("digest"), *doc), "digests")


class DigestIndex:
    """The digests seen so far, one row each with the row that stays for it, in a table bucketed and sorted by digest.

    A new batch is grouped by digest (partial aggregation, so a text with very many copies is no hot key), joined to the
    index by a sort-merge anti-join on its buckets, and what is new is appended. A digest keeps its first batch's row;
    inside a batch the largest id stays, among equal ids the last row, and ids that are null lose to all others.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int | None = None):
        """``buckets``: as many as the session has shuffle partitions, unless given; an index keeps the number it began with."""
        self.spark, self.name = spark, name
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not spark.catalog.tableExists(name):
            self._append(spark.createDataFrame([], "digest string, keep_id long, keep_row long"))

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame) -> None:
        """Append the digests of (row, id, digest) that the index does not hold."""
        new = batch.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"))
        new = new.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
        # a table of its own: the index cannot be read and appended to in one plan
        fresh = stored(new.join(self.rows().hint("merge"), "digest", "left_anti"), "fresh")
        self._append(fresh)


def _ingest_all(rows: DataFrame, index: DigestIndex) -> None:
    """Two batches, larger ids first, so that what the index keeps is the largest id of all; rows without an id go with the second."""
    middle = rows.agg(F.expr("cast(floor(min(id) / 2.0 + max(id) / 2.0) as bigint)").alias("middle")).first()["middle"]
    late = F.coalesce(F.col("id") > F.lit(middle), F.lit(False))
    for batch in (rows.filter(late), rows.filter(~late)):
        index.ingest(batch.select("row", "id", "digest"))


def exact_duplicates(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256. The index is empty or holds earlier rows.

    Equal means identical after lower-casing A-Z. The row with the largest id stays, unless the index knows the text already;
    of repeated rows (same id and text) one stays. Null texts are empty texts. An empty table gives an empty result.
    """
    rows = digests(docs, id_column, text_column)
    before = index.rows().select("digest", F.lit(True).alias("old"))
    known = stored(rows.select("digest").distinct().join(before, "digest"), "known")
    _ingest_all(rows, index)
    # sizes are counted first and stored: the join back meets plain tables, whose hot keys adaptive execution splits
    sizes = rows.groupBy("digest").agg(F.count("*").alias("group_size")).join(index.rows(), "digest").join(known, "digest", "left")
    marked = rows.join(stored(sizes, "sizes"), "digest")
    return marked.select(F.col("id").alias(id_column), "keep_id", "group_size",
                         (F.col("old").isNull() & (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"))


def without_duplicates(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns, for an index that starts empty."""
    rows = digests(docs, id_column, text_column, whole=True)
    _ingest_all(rows, index)
    stay = stored(index.rows().select(F.col("keep_row").alias("row")), "stay")
    # both sides are shuffled at every size: the rows that stay grow with the input and are never broadcast
    return rows.join(stay.hint("merge"), "row", "left_semi").select("doc.*")
