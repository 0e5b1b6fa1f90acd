"""Conversation prefix trie with totals per subtree, rolled up by bands of depths.

A node is a distinct sequence of first turns; conversations that start with it are its members.

1. Turns are numbered in their conversations and reduced to a digest and a word count, so no text
   travels. A prefix is known by the sums of two 64-bit hashes of its (place, digest) pairs, which
   running sums give for conversations of any length.
2. Nodes are counted by prefix; equal prefixes of a task meet before the shuffle.
3. Bands of HEIGHT depths: each node explodes to its ancestors inside its band only, which are in
   one short row per conversation and band. Sums over these give every node's total in its band.
4. Nodes on top of a band form a trie of their own, HEIGHT times flatter, which is rolled up in the
   same way; so completed totals of band roots are known after about log(depth) / log(HEIGHT)
   rounds. Each then goes to the nodes above it in the band before its own.

A step reaches HEIGHT ancestors at most, so rows grow by no more than that however deep the trie is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewloom.operators.skew import lookup, sum_before
from viewloom.operators.staging import stored

HEIGHT = 8
PIECE = 10_000  # ids joined to one piece of text
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Stored (conv, pos, digest, words): the turns of each conversation, numbered from 0.

    Turns go by `turn`, a null first, then by the digest of role and text. A null role or text
    is empty. Rows without a conversation are left out; repeated rows are repeated turns.
    """
    role, text = F.coalesce(F.col(f"`{role}`"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = rows.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").alias("conv"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("digest")).alias("place"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    found = sum_before(stored(turns), "place", {"pos": F.lit(1).cast("long")}, by=["conv"])
    return stored(found.select("conv", "pos", F.col("place.digest").alias("digest"), "words"))


def lengths_of(turns: DataFrame) -> DataFrame:
    """(conv, n_rows): how many turns each conversation has."""
    return stored(turns.groupBy("conv").agg(F.count("*").alias("n_rows")))


def with_shared_heads(turns: DataFrame, lengths: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation from the first `head` turns of the conversation `base`, then its own after as many.

    `base` and `head` are expressions of `conv`; `head` is `most` at most. A shorter base gives all its turns, an
    absent one none. Returns the rebuilt turns (conv, depth from 1, digest, words) and (conv, n_rows, length).
    """
    bases = lengths.select(F.col("conv").alias("of"), F.col("n_rows").alias("n_base"))
    plans = lengths.select("conv", "n_rows", base.alias("base"), head.cast("long").alias("head"))
    plans = plans.join(bases, F.col("base") == F.col("of"), "left")
    taken = F.least("head", F.coalesce("n_base", F.lit(0)))
    own = F.greatest(F.lit(0), F.col("n_rows") - F.col("head"))
    plans = stored(plans.select("conv", "n_rows", "base", "head", taken.alias("taken"), (taken + own).alias("length")))

    first = turns.where(F.col("pos") < most).select(F.col("conv").alias("of"), "pos", "digest", "words")
    wanted = plans.where("taken > 0")
    heads = wanted.join(first, (F.col("base") == F.col("of")) & (F.col("pos") < F.col("taken")))
    shift = plans.select(F.col("conv").alias("of"), "head", "taken")
    rest = lookup(turns, shift, {"conv": "of"}, "inner", spread=["pos"], counts=lengths).where("pos >= head")
    rebuilt = heads.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "words").union(
        rest.select("conv", (F.col("pos") - F.col("head") + F.col("taken") + 1).alias("depth"), "digest", "words")
    )
    return stored(rebuilt), plans.select("conv", "n_rows", "length")


def prefixes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Stored (conv, depth, a, b, words, ends): every conversation's prefixes, the empty one included.

    `a` and `b` name the prefix; `ends` marks the whole conversation.
    """
    tag = lambda seed: F.xxhash64(F.lit(seed), "depth", "digest").cast("decimal(20,0)")
    counts = plans.select("conv", F.col("length").alias("n_rows"))
    tagged = stored(turns.select("conv", "depth", "words", tag(1).alias("x"), tag(2).alias("y")))
    sums = {"sx": F.col("x"), "sy": F.col("y")}
    summed = sum_before(tagged, "depth", sums, by=["conv"], counts=counts.where("n_rows > 0"))
    name = lambda seed: F.xxhash64(F.lit(seed), "depth", F.col("sx") + F.col("x"), F.col("sy") + F.col("y"))
    steps = summed.select("conv", "depth", name(1).alias("a"), name(2).alias("b"), "words")
    zero = F.lit(0).cast("long")
    roots = plans.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    ends = plans.select(F.col("conv").alias("of"), "length")
    counts = plans.select("conv", (F.col("length") + 1).alias("n_rows"))
    steps = lookup(steps.union(roots), ends, {"conv": "of"}, "inner", spread=["depth"], counts=counts)
    return stored(steps.select("conv", "depth", "a", "b", "words", (F.col("depth") == F.col("length")).alias("ends")))


def _paths(steps: DataFrame, height: int) -> DataFrame:
    """A row per conversation and band: the prefixes in it, by depth; at most `height`."""
    one = F.struct("depth", "a", "b")
    return steps.groupBy("conv", F.floor(F.col("depth") / height).cast("long").alias("band")).agg(F.sort_array(F.collect_list(one)).alias("path"))


def _summed(parts: DataFrame, sums: list[str]) -> DataFrame:
    """Per node (a, b, depth) its sums and the least conversation that brings any: the one that has the node."""
    return parts.groupBy("a", "b", "depth").agg(F.min("conv").alias("conv"), *[F.sum(c).alias(c) for c in sums])


def _rolled(steps: DataFrame, values: DataFrame, sums: list[str], height: int) -> DataFrame:
    """Per node the sums over its subtree: (a, b, depth, conv, *sums).

    `steps` has all prefixes of all conversations, `values` a row per node: (conv, depth, *sums),
    where conv is the least conversation that has the node.
    """
    paths = stored(_paths(steps, height))
    band = F.floor(F.col("depth") / height).cast("long")
    nodes = values.select("conv", F.col("depth").alias("at"), band.alias("band"), *sums)
    reached = nodes.join(paths, ["conv", "band"]).select(
        "conv", F.explode(F.filter("path", lambda p: p["depth"] <= F.col("at"))).alias("p"), *sums
    )
    inside = stored(_summed(reached.select("conv", "p.a", "p.b", "p.depth", *sums), sums))
    if values.where(F.col("depth") >= height).isEmpty():
        return inside

    flat = (F.col("depth") / height).cast("long").alias("depth")
    tops = steps.where(F.col("depth") % height == 0).select("conv", flat, "a", "b")
    weights = inside.where(F.col("depth") % height == 0).select("conv", flat, *sums)
    whole = _rolled(tops, stored(weights), sums, height).where("depth > 0")
    above = whole.select("conv", (F.col("depth") - 1).alias("band"), *sums).join(paths, ["conv", "band"])
    passed = above.select("conv", F.explode("path").alias("p"), *sums).select("conv", "p.a", "p.b", "p.depth", *sums)
    return stored(_summed(inside.select("conv", "a", "b", "depth", *sums).union(passed), sums))


def _ends(steps: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): the digest of each node's ending conversations, ascending and joined by commas.

    Ids are sorted and joined in ranges over all tasks, then a task goes through a node's pieces of
    text in order; it holds one of them at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (c.to_pylist() for c in batch.columns)
            out, at = [], 0
            while at < len(ids):
                end = at + 1
                while end < len(ids) and end - at < PIECE and a[end] == a[at] and b[end] == b[at]:
                    end += 1
                out.append((a[at], b[at], ids[at], ",".join(map(str, ids[at:end]))))
                at = end
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, out = None, None, []
        for batch in batches:
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != now:
                    if now:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (a, b), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _digest_rows(out)
            out = []
        if now:
            yield _digest_rows([(*now, digest.hexdigest())])

    def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, kinds)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "ends_sha256"])

    order = ["a", "b", "conv"]
    ranged = steps.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = ranged.mapInArrow(pieces, "a long, b long, first long, ids string")
    texts = texts.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return texts.mapInArrow(digests, "a long, b long, ends_sha256 string")


def trie(steps: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `steps` are stored prefixes. A node is named by its least member and its depth. `n_leaves` and
    `saved_tokens` are summed over the subtree: childless nodes, and words of the last turn for each
    member but one. `ends_sha256` is the digest of the members that end at the node. No conversations
    give no nodes, not even a root.
    """
    members = [F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.max("words").alias("words")]
    nodes = stored(steps.groupBy("a", "b", "depth").agg(*members))
    # a node all of whose members end there has no children; each other node counts one for its parent
    values = nodes.select(
        "conv", "depth", (F.col("n_convs") == F.col("n_ends")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = _rolled(steps, stored(values), ["n_leaves", "saved_tokens"], height)
    totals = totals.select(*[F.col(c).alias(f"t_{c}") for c in ("a", "b", "depth")], "n_leaves", "saved_tokens")

    # the least member of a node also is the least of all deeper nodes on its way, so its parent's
    # prefix is in its own steps
    up = steps.select(F.col("conv").alias("of"), (F.col("depth") + 1).alias("below"), F.col("a").alias("pa"), F.col("b").alias("pb"))
    placed = nodes.join(up, (F.col("conv") == F.col("of")) & (F.col("depth") == F.col("below")), "left").drop("of", "below")
    placed = stored(placed)
    children = stored(placed.where("pa IS NOT NULL").groupBy("pa", "pb").agg(F.count("*").alias("n_rows")))
    parents = nodes.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("conv").alias("parent_conv_id"))
    named = lookup(placed, parents, {"pa": "qa", "pb": "qb"}, "left", spread=["a"], counts=children)
    kids = children.select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), F.col("n_rows").alias("n_children"))
    ends = _ends(steps).select(F.col("a").alias("ea"), F.col("b").alias("eb"), "ends_sha256")
    found = named.join(totals, (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")) & (F.col("depth") == F.col("t_depth")))
    found = found.join(kids, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left")
    found = found.join(ends, (F.col("a") == F.col("ea")) & (F.col("b") == F.col("eb")), "left")
    return found.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
