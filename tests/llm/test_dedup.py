"""Exact dedup against plain grouping."""

import hashlib

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents
from viewloom.llm import exact_dedup


def weak(text):
    return F.length(text) % 3


def expected(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    pick = min if keep == "smallest" else max
    return {i: (pick(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def check(spark, keep, digest):
    rows = list(enumerate(AWKWARD + AWKWARD[::-1]))
    got = by_id(exact_dedup.ledger(documents(spark, [t for _, t in rows]), keep=keep, digest=digest))
    want = expected(rows, keep)
    assert {i: (r.keep_id, r.group_size, r.text_sha256) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][0]) for i, r in got.items())


def test_groups(spark):
    check(spark, "largest", exact_dedup.content_hash)
    check(spark, "smallest", exact_dedup.content_hash)


def test_collisions_are_told_apart(spark):
    check(spark, "smallest", weak)


def test_survivors_keep_all_columns(spark):
    docs = documents(spark, AWKWARD + AWKWARD).withColumns(
        {"kept": F.lit("mine"), "_hash": F.lit(1), "group_size": F.lit(None), "_row": F.lit("r")}
    )
    for digest in (exact_dedup.content_hash, weak):
        out = exact_dedup.survivors(docs, digest=digest)
        assert out.columns == docs.columns
        rows = out.collect()
        assert sorted({r.text or "" for r in rows}) == sorted({t or "" for t in AWKWARD})
        assert len(rows) == len({t or "" for t in AWKWARD}) and {r.kept for r in rows} == {"mine"}
        assert max(r.doc_id for r in rows) < len(AWKWARD)


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c")])
    rows = exact_dedup.ledger(docs).collect()
    assert len(rows) == 6 and sum(r.kept for r in rows) == 3
    assert {r.keep_id for r in rows if r.group_size == 3} == {1}
    kept = sorted((r.doc_id or 0, r.text) for r in exact_dedup.survivors(docs).collect())
    assert kept == [(0, "b"), (1, "a"), (2, "c")]


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.ledger(docs).count() == 0 and exact_dedup.survivors(docs).count() == 0
