"""The trie against plain dictionaries, with low bands so that totals pass several of them."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from viewloom.llm import prefix_trie
from viewloom.operators import skew

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, digest), role, text))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    totals = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].split()) if path else 0
        totals[path] = (
            sum(totals[k][0] for k in children[path]) if children[path] else 1,
            saved + sum(totals[k][1] for k in children[path]),
        )
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(children[p]), *totals[p],
         hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def got(rows, height):
    turns = prefix_trie.turns_of(rows)
    base, head = F.col("conv") - F.col("conv") % 20, F.crc32(F.col("conv").cast("string")) % 4
    rebuilt, plans = prefix_trie.with_shared_heads(turns, prefix_trie.lengths_of(turns), base, head, most=3)
    out = prefix_trie.trie(prefix_trie.prefixes(rebuilt, plans), height).collect()
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in out)


def conversations():
    rows = []
    for c in range(20, 75):  # common first turns, whole copies, prefixes of others
        length = c % 7 + 1
        rows += [(c, t, "user" if t % 2 == 0 else "bot", f"turn {t} of {c % 3 if t > 1 else 'all'}") for t in range(length)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 112) for t in range(5)]
    rows += [(200, t, "x", "again and again") for t in range(40)] + [(201, t, "x", "again and again") for t in range(37)]
    rows += [(333, None, None, None), (333, 0, "", "a"), (333, 0, "", "a"), (334, 1, None, "w " * 5000), (None, 1, "user", "lost")]
    rows += [(450, 0, "user", "short base"), (451, 0, "user", "one"), (452, 0, "u", "two"), (452, 1, "u", "three"), (-5, 0, "u", "minus")]
    return rows


def test_same_as_plain_trie(spark, monkeypatch):
    """Bands of 3 depths, a trie of 40: totals pass bands of bands; every key is dealt as if it were hot."""
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 3)
    rows = conversations()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({"conv": F.lit(1), "depth": F.lit("d"), "a": F.lit(0)})
    assert got(docs, 3) == plain(rows)


def test_pieces_of_a_long_list_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    steps = spark.createDataFrame([(c, 1, 7, 9, 1, True) for c in range(95, 130)], "conv long, depth long, a long, b long, words long, ends boolean")
    (row,) = prefix_trie._ends(steps).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, range(95, 130))).encode()).hexdigest()


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA), 8) == []
