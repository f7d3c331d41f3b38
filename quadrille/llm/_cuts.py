"""Cutting byte spans out of a table's texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import BROADCAST_BYTES

#: Spans to keep of one row's text, in bytes; row is row_key() of its doc_id and text.
CUTS = "row bigint, doc_id bigint, keep array<struct<a:int,b:int>>, n_cut bigint"


def row_key(doc_id: Column, text: Column) -> Column:
    """One value for rows that agree in both; never null."""
    return F.xxhash64(doc_id.cast("bigint"), text.cast("string"))


def kept(removed: list[tuple[int, int]]) -> list[dict[str, int]]:
    """What is left of a text without these ascending spans; the last span is open."""
    out, at = [], 0
    for a, b in removed:
        if a > at:
            out.append({"a": at, "b": a})
        at = max(at, b)
    return [*out, {"a": at, "b": 2**31 - 1}]


def cut(docs: DataFrame, side: DataFrame, item: str, new: Callable[[Column, Column], Column]) -> DataFrame:
    """docs with new(text, item) as text in the rows that side (a written table: row, doc_id, item) names; n_chars, where there is such a
    column, is counted again for those rows."""
    key = "_row"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    rows, items = side.agg(F.count("*"), F.sum(F.size(item))).first()
    side = side.select(F.col("row").alias(key + "_row"), F.col("doc_id").alias(key + "_id"), F.col(item).alias(key + "_item"))
    side = F.broadcast(side) if 96 * rows + 40 * (items or 0) <= BROADCAST_BYTES else side.hint("shuffle_hash")
    # by doc_id and 64 bits of both: texts of other documents can't be taken for this one
    both = docs.join(side, (row_key(docs["doc_id"], docs["text"]) == F.col(key + "_row")) & docs["doc_id"].cast("bigint").eqNullSafe(F.col(key + "_id")), "left")
    what = F.col(key + "_item")
    both = both.withColumn(key + "_new", new(F.when(what.isNotNull(), F.col("text").cast("string")), what))
    changed = F.col(key + "_new")
    both = both.withColumn("text", F.coalesce(changed, F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(changed.isNull(), F.col("n_chars")).otherwise(F.length(changed).cast(docs.schema["n_chars"].dataType)))
    return both.select(*docs.columns)


def keep_bytes(text: Column, keep: Column) -> Column:
    """The kept spans of a text (CUTS), joined."""
    raw = text.cast("binary")
    return F.array_join(F.transform(keep, lambda s: F.substring(raw, s["a"] + 1, s["b"] - s["a"]).cast("string")), "")
