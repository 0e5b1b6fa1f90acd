"""The manifest against a plain tree, with small blocks so that the exchange has several rounds."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, documents
from viewloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, fanout):
    """The root, and per node its proof as (left, right) texts."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // fanout * fanout
            proofs[i].append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + fanout])))
        nodes = [h("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [k // fanout for k in at]
    return nodes[0], proofs


def plain(rows, fanout):
    """(doc_id, source, lang, n_chars, text) rows to sorted (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for row in rows:
        groups.setdefault("" if row[1] is None else "=" + row[1], []).append(row)
    names = sorted(groups, key=str.encode)
    members = {n: sorted(groups[n], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for n in names}
    trees = {n: climb([leaf(r) for r in members[n]], fanout) for n in names}
    root, above = climb([trees[n][0] for n in names], fanout)
    return sorted(
        ((r[0], leaf(r), trees[n][0], root, p + above[i]) for i, n in enumerate(names) for r, p in zip(members[n], trees[n][1])), key=repr
    )


def got(docs, fanout, height):
    out = merkle.manifest(docs, fanout=fanout, height=height, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    out = out.withColumn("folded", merkle.folded(F.coalesce("tampered_leaf", "leaf"), F.col("proof"))).collect()
    for r in out:
        changed = r.tampered_leaf is not None and r.tampered_leaf != r.leaf
        assert (r.folded == r.root) != changed
        assert (r.tampered_leaf is not None) == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in out), key=repr)


@pytest.mark.parametrize("fanout, height", [(2, 2)])
def test_same_as_plain_tree(spark, fanout, height):
    """A hot source, sources of 1 to 9 rows, null and empty sources, null ids, repeated rows and ids, all field nulls."""
    rows = [(i * 7 % 401, "hot", "en", i, f"Text {i}") for i in range(37)]
    rows += [(1000 + 10 * s + i, f"sé{s}", None, None, t) for s in range(1, 10) for i, t in zip(range(s), AWKWARD)]
    rows += [(5000, None, None, None, None), (None, None, "de", 3, "abc"), (None, "hot", "de", 3, "ABC"), (5001, "", "x", 0, "")]
    rows += [rows[3], rows[3], (rows[4][0], "hot", "fr", 1, "other"), (-7, "hot", "x", 1, "Z" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(4)
    docs = docs.withColumns({"key": F.lit("k"), "pos": F.lit(1), "leaf": F.lit("x"), "root": F.lit(2), "name": F.lit("n")})
    assert got(docs, fanout, height) == plain(rows, fanout)


def test_one_row_and_none(spark):
    one = documents(spark, [(7, "Only")])
    (row,) = merkle.manifest(one).collect()
    assert row.proof == [] and row.leaf == row.subroot == row.root == leaf((7, "s", "en", 4, "Only"))
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
