"""Links stored by their ends, so that the links of one node are found without a scan of all.

Every link is written once for each of its ends, bucketed by that end and sorted inside buckets. A
look-up reads one bucket, of which Parquet skips what lies outside the node's range.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from viewloom.functions.columns import is_key, key_literal, type_of
from viewloom.operators.skew import hinted, hot_keys, row_hash
from viewloom.operators.staging import scratch

END = "_end"
LINKS_PER_BUCKET = 1_000_000


def _end(value: Column, dtype: T.DataType) -> Column:
    """What a link is stored under: the end itself, or the text of a mixed key."""
    return F.concat(value.getField("kind"), F.lit(":"), value.getField("value")) if is_key(dtype) else value


@dataclass(frozen=True)
class LinkIndex:
    """A bucketed table of links; `columns` are those of the links."""

    frame: DataFrame
    table: str
    dtype: T.DataType
    columns: tuple[str, ...]

    def incident(self, node: object) -> DataFrame:
        """The links with the node at either end, each once, as `links.touching` gives them."""
        wanted = _end(key_literal(node), self.dtype) if is_key(self.dtype) else F.lit(node)
        return self.frame.where(F.col(END) == wanted).select(*self.columns)

    def drop(self) -> None:
        self.frame.sparkSession.sql(f"DROP TABLE IF EXISTS {self.table}")


def index(link_rows: DataFrame, buckets: int | None = None) -> LinkIndex:
    """Store links (source, target, ...) by both ends. Repeated links stay repeated; a null end is not stored.

    The links of a hub are written by several tasks, as several files of its bucket.
    """
    spark, dtype = link_rows.sparkSession, type_of(link_rows, "source")
    source, target = _end(F.col("source"), dtype), _end(F.col("target"), dtype)
    ends = F.when(source.eqNullSafe(target), F.array(source)).otherwise(F.array(source, target))
    rows = link_rows.select(F.explode(ends).alias(END), *link_rows.columns).where(F.col(END).isNotNull())
    if buckets is None:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * link_rows.count() // LINKS_PER_BUCKET))
    hot = hot_keys(rows, [END], ["_hub"])
    if hot is None:
        dealt = rows.repartition(buckets, END)
    else:
        slot = F.pmod(row_hash(rows), F.col("_slots").cast("bigint"))
        marked = rows.join(hinted(hot.drop("_rows")), F.col(END) == F.col("_hub"), "left")
        dealt = marked.withColumn("_slot", F.coalesce(slot, F.lit(0))).repartition(END, "_slot").select(END, *link_rows.columns)
    name = f"links_{uuid.uuid4().hex}"
    dealt.write.format("parquet").bucketBy(min(buckets, 100_000), END).sortBy(END).option("path", scratch(spark, name)).saveAsTable(name)
    return LinkIndex(spark.table(name), name, dtype, tuple(link_rows.columns))
