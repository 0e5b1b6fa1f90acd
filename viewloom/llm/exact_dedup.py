"""Exact dedup: group by a 128-bit content hash and compare the bytes inside each group.

Rows are counted by hash. Grouping those found more than once by (hash, text) is the byte
comparison: Spark probes by the key's hash and then compares the text bytes, and it combines on
the map side, so a group of copies reaches the shuffle at most once per task however large it is.
Otherwise only hashes travel; the text joins again only if one hash was found with two texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from viewloom.operators.skew import lookup
from viewloom.operators.staging import stored


def content_hash(text: Column) -> Column:
    """The 128-bit hash of the UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _rows(docs: DataFrame, id_column: str, text_column: str, digest: Callable[[Column], Column], *more: Column):
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(*more, F.col(id_column).alias("_id"), text.alias("_text"), digest(text).alias("_hash"))


def _classes(rows: DataFrame, keep: str) -> tuple[DataFrame, list[str]]:
    """One row per distinct text, stored without the text; and the columns that identify it."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    by_bytes = rows.groupBy("_hash", "_text").agg(
        F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id")
    )
    sizes = ["_hash", "group_size", "keep_id", F.sha2("_text", 256).alias("text_sha256")]
    classes = stored(by_bytes.select(*sizes))
    collisions = classes.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if collisions.isEmpty():
        return classes, ["_hash"]
    return stored(by_bytes.select(*sizes, "_text")), ["_hash", "_text"]


def _compared(rows: DataFrame, keep: str) -> tuple[DataFrame, list[str]]:
    """As `_classes`, without the digest of the text, where a text travels only if its hash was found more than once."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    sizes = [F.count(F.lit(1)).alias("group_size"), best("_id").alias("keep_id")]
    hashes = stored(rows.groupBy("_hash").agg(*sizes))
    many = stored(hashes.where("group_size > 1").select("_hash", F.col("group_size").alias("n_rows")))
    suspects = lookup(rows.select("_hash", "_text"), many.select(F.col("_hash").alias("_of")), {"_hash": "_of"}, "left_semi", counts=many)
    # copies meet on the map side: a text reaches the shuffle once per task at most
    texts = suspects.groupBy("_hash", "_text").agg(F.count(F.lit(1)).alias("n")).groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    if texts.where("n > 1").isEmpty():
        return hashes, ["_hash"]
    return stored(rows.groupBy("_hash", "_text").agg(*sizes)), ["_hash", "_text"]


def ledger(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    digest: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """Per row: its id, keep_id, group_size, kept and text_sha256.

    Rows are copies if their texts are the same bytes; a null text counts as empty. The row
    with the smallest (or largest) id stays; a null id stays only where its group has no
    other. Of rows repeated with the same id and text exactly one is kept. Other columns of
    `docs` are not looked at, whatever their names. An empty table gives an empty ledger.
    A different `digest` changes the cost, never the result.
    """
    rows = _rows(docs, id_column, text_column, digest)
    classes, key = _compared(rows, keep)
    found = lookup(
        rows.select("_id", F.unhex(F.sha2("_text", 256)).alias("_sha"), *key),
        classes,
        {k: k for k in key},
        "inner",
        spread=["_id"],
        counts=classes.select(*key, F.col("group_size").alias("n_rows")),
    )
    alike = Window.partitionBy("_id", "keep_id", "_sha").orderBy("group_size")
    first = F.row_number().over(alike) == 1
    return found.select(
        F.col("_id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest",
              digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that `ledger` keeps, with all columns of `docs`.

    Of rows repeated with the same id and text, the one whose columns hash lowest stays.
    """
    rows = _rows(docs, id_column, text_column, digest, F.struct("*").alias("_row"))
    classes, key = _classes(rows.drop("_row"), keep)
    # plain equalities that hold for null ids as well: the window then needs no shuffle of its own
    none = F.lit("0").cast(docs.schema[id_column].dataType)
    same = {"_null": F.isnull("_id"), "_key": F.coalesce("_id", none)}
    kept = classes.select(
        F.isnull("keep_id").alias("_null"), F.coalesce("keep_id", none).alias("_key"), *key
    )
    together = ["_null", "_key", *key]
    alike = Window.partitionBy(*together).orderBy(F.xxhash64("_row"))
    chosen = rows.withColumns(same).join(kept, together, "inner").withColumn("_n", F.row_number().over(alike))
    return chosen.where("_n = 1").select("_row.*")
