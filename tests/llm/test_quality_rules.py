"""Rules against a plain count per text, and the ledger's policies and ablations."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents, prose
from viewloom.llm import quality_rules as rules

TEXTS = AWKWARD + [
    prose(1, 300), (prose(2, 12) + " ") * 9, prose(3, 30) + " " + prose(3, 30), "| ".join(prose(4, 60).split()),
    prose(5, 40).upper(), "*** ".join(prose(6, 40).split()), "same line here\n" * 6, "1 2 3 4 5 6 7 " * 5, prose(7, 8), prose(8, 7),
]


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_letters": sum(c.isalpha() for c in text), "n_upper": sum(c.isupper() for c in text),
    }


def test_measurements(spark, monkeypatch):
    docs = documents(spark, TEXTS).withColumn("failed", F.lit("x"))
    want = {i: measured(t) for i, t in enumerate(TEXTS)}
    for block in (rules.BLOCK_BYTES, 50):
        monkeypatch.setattr(rules, "BLOCK_BYTES", block)
        got = by_id(rules.ledger(docs))
        assert {i: {m: r[m] for m in rules.MEASURES} for i, r in got.items()} == want


def test_verdicts(spark):
    got = by_id(rules.verdicts(rules.ledger(documents(spark, TEXTS))))
    for i, t in enumerate(TEXTS):
        m = measured(t)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        assert got[i].base_failed == base and not (base and got[i].kept)
    assert got[TEXTS.index(prose(1, 300))].kept
    for junk in ("| ", "*** "):
        assert any(not got[i].base_failed and not got[i].kept for i, t in enumerate(TEXTS) if t and junk in t)


def test_ablations(spark):
    ledger = rules.ledger(documents(spark, TEXTS * 3)).cache()
    masks = [r.failed for r in ledger.collect()]
    names = list(rules.rules())
    got = {(r.version, r.rule): (r.n_failed, r.n_only, r.n_rejected) for r in rules.ablations(ledger).collect()}
    assert set(got) == {(v, r) for v, p in rules.POLICIES.items() for r in p}
    for (version, rule), counts in got.items():
        policy, bit = rules.mask_of(rules.POLICIES[version]), 1 << names.index(rule)
        assert counts == (sum(m & bit > 0 for m in masks), sum(m & policy == bit for m in masks), sum(m & policy > 0 for m in masks))


def test_what_alone_rejects(spark):
    names = list(rules.rules())
    for r in rules.ablated(rules.ledger(documents(spark, TEXTS))).collect():
        for version, some in rules.POLICIES.items():
            failed = [n for k, n in enumerate(names) if r.failed >> k & 1 and n in some]
            assert r[f"kept_{version}"] == (not failed)
            assert r[f"only_{version}"] == (failed[0] if len(failed) == 1 else None)


def test_empty(spark):
    ledger = rules.ledger(spark.createDataFrame([], SCHEMA))
    assert rules.verdicts(ledger).count() == 0 and rules.ablations(ledger).count() == 0
