"""Mission handles and names from plain-text listings; whole texts, one row per text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns ((?U) gives Unicode word boundaries)
EDGES = r"(?U)^\s+|\s+$"
ANSI = r"\x1b\[[0-9;]*m"
UUID = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
SHORT_TOKEN = r"(?U)\b([^\s\|:│]+-[0-9]+)\b"
SHORT_LABEL = r"(?iU)\bshort\s*name\b\s*(?:[│|:])\s*([^\s\|:│]+)"


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, ANSI, "")


def _lines(df: DataFrame, text: str) -> DataFrame:
    return df.select("doc_id", F.posexplode(F.split(strip_ansi(F.col(text)), r"\r\n|\n|\r")).alias("line_no", "line"))


def handles(df: DataFrame, text: str = "text", token: str = SHORT_TOKEN, uuid: str = UUID) -> DataFrame:
    """(doc_id, handle): ids of each line in lower case; on lines without id and ellipsis the short tokens."""
    ids = F.transform(F.regexp_extract_all("line", F.lit(uuid), F.lit(0)), F.lower)
    tokens = F.when(F.col("line").contains("…"), F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all("line", F.lit(token), F.lit(0)))
    found = _lines(df, text).select("doc_id", F.explode(F.when(F.size(ids) > 0, ids).otherwise(tokens)).alias("handle"))
    return found.distinct()


def mission_names(df: DataFrame, text: str = "text", uuid: str = UUID) -> DataFrame:
    """(doc_id, handle, name): second cell of the first table row that shows an id."""
    cells = F.filter(F.transform(F.split("line", "[│|]"), lambda c: F.regexp_replace(c, EDGES, "")), lambda c: c != "")
    rows = _lines(df, text).withColumns({"_cells": cells, "_ids": F.regexp_extract_all("line", F.lit(uuid), F.lit(0))})
    named = rows.where(F.size("_cells") >= 3).select("doc_id", "line_no", F.explode("_ids").alias("_id"), F.get("_cells", F.lit(1)).alias("name"))
    return named.groupBy("doc_id", F.lower("_id").alias("handle")).agg(F.min_by("name", "line_no").alias("name"))


def id_and_short_name(df: DataFrame, text: str = "text", token: str = SHORT_TOKEN, label: str = SHORT_LABEL, uuid: str = UUID) -> DataFrame:
    """First id of a text, and its labelled short name or else its first token."""
    clean = strip_ansi(F.col(text))
    some = lambda c: F.nullif(c, F.lit(""))
    return df.select("doc_id", some(F.lower(F.regexp_extract(clean, uuid, 0))).alias("id"),
                     F.upper(F.coalesce(some(F.regexp_extract(clean, label, 1)), some(F.regexp_extract(clean, token, 0)))).alias("short_name"))
