"""Merkle dataset manifest: a hash tree over all rows, and for every row the proof that it belongs.

1. Every row becomes a leaf digest. Rows are dealt over tasks by ranges of (group, id), so a group
   of any size is spread; counts per task and group place each leaf inside its group.
2. Aligned blocks of FANOUT ** HEIGHT leaves are hashed up to the block's root, a task a block.
3. Butterfly exchange: in round r the FANOUT blocks whose numbers differ in digit r alone swap the
   roots of their subtrees, and each of them hashes the same parent. A block so holds its upper
   proof after the last round, and nothing is passed down again. A subtree that ends early has
   fewer blocks than partners ask; its blocks stand in for the missing ones, in turn, so a round
   sends less than twice as many rows as there are blocks.
4. The groups' roots are leaves of one more tree, built alike.

Only digests travel: about 100 bytes a row, and a row per block and round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from viewloom.llm.common import ascii_lower
from viewloom.operators.skew import lookup
from viewloom.operators.staging import stored

FANOUT = 16
HEIGHT = 3  # a block holds FANOUT ** HEIGHT leaves at most
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left:string,right:string>"
_PLACED = ["key", "block", "pos", "total", "name", "leaf", "other"]


def field_text(column: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; a null as a dash."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: Sequence[Column]) -> Column:
    """The lower-case hex SHA-256 of a row's values."""
    return F.sha2(F.concat(*map(field_text, columns)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof come to."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The hex SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _levels(n: int, fanout: int) -> int:
    """How many levels lie above n nodes until one is left."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fanout
    return levels


def _climb(leaves: list[str], levels: int, fanout: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """The node on top of a block's leaves, and per level for each node what is left and right of it."""
    nodes, beside = leaves, []
    for _ in range(levels):
        runs = [nodes[at : at + fanout] for at in range(0, len(nodes), fanout)]
        beside.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
        nodes = [hashlib.sha256("".join(run).encode()).hexdigest() for run in runs]
    return nodes[0], beside


def _block(rows: pa.Table, fanout: int, height: int) -> tuple[pa.Table, str, list[list[tuple[str, str]]]]:
    rows = rows.sort_by("pos")
    leaves = [x.hex() for x in rows.column("leaf").to_pylist()]
    levels = min(height, _levels(rows.column("total")[0].as_py(), fanout))
    return rows, *_climb(leaves, levels, fanout)


def _placed(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """Stored rows (key, block, pos, total, name, leaf, other): places ascend by name, then leaf, from 0 in each key."""
    order = ["key", F.col("name").asc_nulls_first(), "leaf"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = stored(ranged.select("key", "name", "leaf", "other", F.spark_partition_id().alias("part"), inside.alias("at")))
    spans = ranged.groupBy("key", "part").agg(F.min("at").alias("first"), F.count("*").alias("n_rows"))
    of_key = Window.partitionBy("key")
    before = of_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("key").alias("k"), F.col("part").alias("p"), "n_rows", F.sum("n_rows").over(of_key).alias("total"),
        (F.coalesce(F.sum("n_rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
    )
    spans = stored(spans)  # a row per key and task that holds it
    counts = spans.select(F.col("k").alias("key"), F.col("p").alias("part"), "n_rows")
    rows = lookup(ranged, spans.drop("n_rows"), {"key": "k", "part": "p"}, "inner", spread=["at"], counts=counts)
    rows = rows.withColumn("pos", F.col("at") + F.col("shift"))
    block = F.floor(F.col("pos") / F.lit(fanout**height)).cast("long")
    return stored(rows.withColumn("block", block).select(*_PLACED))


def _block_roots(placed: DataFrame, fanout: int, height: int) -> DataFrame:
    """A row per block: key, block, n_blocks, root, and a path that is still empty."""

    def run(rows: pa.Table) -> pa.Table:
        rows, root, _ = _block(rows, fanout, height)
        n_blocks = -(-rows.column("total")[0].as_py() // fanout**height)
        return pa.table({"key": rows.column("key")[:1], "block": rows.column("block")[:1], "n_blocks": pa.array([n_blocks], pa.int64()), "root": [root]})

    found = placed.groupBy("key", "block").applyInArrow(run, "key string, block long, n_blocks long, root string")
    return found.withColumn("path", F.array().cast(f"array<{_STEP}>"))


def _exchanged(blocks: DataFrame, fanout: int) -> DataFrame:
    """The blocks after all rounds: `root` is the key's, `path` leads there from the block's own root."""
    blocks = stored(blocks)
    most, reach = blocks.agg(F.max("n_blocks")).first()[0] or 1, 1
    while reach < most:
        subtree = F.floor(F.col("block") / reach).cast("long")
        low = F.col("block") % reach
        members = F.least(F.lit(reach), F.col("n_blocks") - subtree * reach)  # fewer at the end only
        sent = blocks.where(F.col("n_blocks") > reach).select(
            "key", "n_blocks", F.floor(F.col("block") / (reach * fanout)).cast("long").alias("high"),
            F.explode(F.sequence(low, F.lit(reach - 1).cast("long"), members)).alias("slot"),
            low.alias("low"), F.struct((subtree % fanout).alias("digit"), "block", "root", "path").alias("message"),
        )
        # at most `fanout` messages meet; a stand-in brings no path
        own = F.col("slot") == F.col("low")
        message = F.struct(
            F.col("message.digit").alias("digit"), F.col("message.root").alias("root"),
            F.when(own, F.col("message.block")).alias("block"), F.when(own, F.col("message.path")).alias("path"),
        )
        met = sent.groupBy("key", "n_blocks", "high", "slot").agg(F.sort_array(F.collect_list(message)).alias("run"))
        joined = lambda run: F.array_join(F.transform(run, lambda m: m["root"]), "")
        met = met.withColumn("parent", F.sha2(joined(F.col("run")), 256))
        met = met.select("key", "n_blocks", "parent", "run", F.explode(F.filter("run", lambda m: m["block"].isNotNull())).alias("me"))
        side = lambda way: joined(F.filter("run", lambda m: way(m["digit"], F.col("me.digit"))))
        step = F.struct(side(lambda a, b: a < b).alias("left"), side(lambda a, b: a > b).alias("right"))
        after = met.select("key", F.col("me.block").alias("block"), "n_blocks", F.col("parent").alias("root"),
                           F.concat("me.path", F.array(step)).alias("path"))
        blocks = stored(after.union(blocks.where(F.col("n_blocks") <= reach)))
        reach *= fanout
    return blocks


def _with_proofs(placed: DataFrame, paths: DataFrame, fanout: int, height: int) -> DataFrame:
    """Per leaf: key, name, leaf, other (hex), subroot, root, and its proof: the path inside its block, then the block's."""
    kind = placed.schema["name"].dataType.simpleString()

    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows, _, beside = _block(rows, fanout, height)
        above = above.to_pylist()[0]
        rest = [(s["left"], s["right"]) for s in above["path"]]
        proofs = [[*(level[i // fanout**depth] for depth, level in enumerate(beside)), *rest] for i in range(rows.num_rows)]
        flat = [step for proof in proofs for step in proof]
        steps = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["left", "right"])
        width = len(beside) + len(rest)
        hexes = lambda name: pa.array([x and x.hex() for x in rows.column(name).to_pylist()], pa.string())
        n = rows.num_rows
        return pa.table({
            "key": rows.column("key"), "name": rows.column("name"), "leaf": hexes("leaf"), "other": hexes("other"),
            "subroot": pa.array([above["subroot"]] * n, pa.string()), "root": pa.array([above["root"]] * n, pa.string()),
            "proof": pa.ListArray.from_arrays(pa.array(range(0, (n + 1) * width, width) if width else [0] * (n + 1), pa.int32()), steps),
        })

    out = f"key string, name {kind}, leaf string, other string, subroot string, root string, proof array<{_STEP}>"
    return placed.groupBy("key", "block").cogroup(paths.groupBy("key", "block")).applyInArrow(run, out)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_column: str = "doc_id",
    group_column: str = "source",
    tampered: Column | None = None,
    text_column: str = "text",
    fanout: int = FANOUT,
    height: int = HEIGHT,
) -> DataFrame:
    """Per row: id, `leaf`, `subroot` (of its group), `root` (of all), `proof` and `tampered_leaf`.

    `proof` lists per level the digests left and right of the row's ancestor, as joined hex text.
    Leaves of a group ascend by id, a null id first; rows with the same id by their digest, so
    repeated rows stay repeated leaves. A null group is a group of its own and comes first, the others
    follow by their UTF-8 bytes. Nulls and empty texts differ in the digest. Where `tampered` holds,
    `tampered_leaf` is the leaf of the row with A-Z in its text in lower case, else it is null.
    Columns outside `fields` are not looked at. An empty table gives no rows.
    """
    values = [F.col(f"`{c}`") for c in fields]
    changed = [ascii_lower(v) if c == text_column else v for c, v in zip(fields, values)]
    other = F.when(tampered, F.unhex(row_digest(changed))) if tampered is not None else F.lit(None).cast("binary")
    group = F.col(f"`{group_column}`").cast("string")
    leaves = docs.select(
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("="), group)).alias("key"),
        F.col(f"`{id_column}`").alias("name"), F.unhex(row_digest(values)).alias("leaf"), other.alias("other"),
    )
    placed = _placed(leaves, fanout, height)
    blocks = _exchanged(_block_roots(placed, fanout, height), fanout)

    subroots = blocks.where("block = 0").select(
        F.lit("").alias("key"), F.col("key").alias("name"), F.unhex("root").alias("leaf"), F.lit(None).cast("binary").alias("other")
    )
    top = _placed(subroots, fanout, height)
    above = _exchanged(_block_roots(top, fanout, height), fanout).select("key", "block", F.lit("").alias("subroot"), "root", "path")
    top = stored(_with_proofs(top, above, fanout, height).select(F.col("name").alias("of"), F.col("root").alias("whole"), F.col("proof").alias("rest")))

    counts = blocks.where("block = 0").select("key", F.col("n_blocks").alias("n_rows"))
    paths = lookup(blocks, top, {"key": "of"}, "inner", spread=["block"], counts=counts).select(
        "key", "block", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("path", "rest").alias("path")
    )
    found = _with_proofs(placed, paths, fanout, height)
    return found.select(F.col("name").alias(id_column), "leaf", "subroot", "root", "proof", F.col("other").alias("tampered_leaf"))
