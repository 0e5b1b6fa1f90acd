"""Random records against short models in plain Python, with ordinary and with forced skew paths."""

import math
import random
from collections import Counter

import pytest

from tests.frames import frame, rows
from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, SeriesSpec
from viewloom.operators import selection, skew

SCHEMA = "ord bigint, c string, v double, l array<string>, l1 string, l2 string, l3 string"
NAMES = ["a", "b", "c", "d", "e", "f", ""]


def records(seed, n=90):
    """Every third record is about `a`; some values, names and lists are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        name = "a" if i % 3 == 0 else rng.choice(NAMES)
        listed = rng.choice([None, [], [rng.choice([*NAMES, "unknown"]) for _ in range(rng.randrange(6))]])
        value = rng.choice([None, float(rng.randrange(0, 40))])
        levels = ["x" if i % 3 == 0 else rng.choice("xyz"), rng.choice(["x", "p", "q", None]), rng.choice("pmn")]
        out.append((i, name, value, listed, *levels))
    return out


@pytest.fixture(scope="module", params=[(1, False), (2, True)], ids=["plain", "dealt"])
def case(request, spark):
    seed, dealt = request.param
    with pytest.MonkeyPatch.context() as patch:
        if dealt:
            for name, value in (("SMALL_ROWS", 0), ("ROWS_PER_TASK", 10)):
                patch.setattr(skew, name, value)
        yield board_of(spark, seed)


def board_of(spark, seed):
    data = records(seed)
    shuffled = random.Random(seed).sample(data, len(data))
    board = Dashboard(
        frame(spark, shuffled, SCHEMA).repartition(3),
        series=SeriesSpec("c", "v", "ord"),
        links=LinkSpec("c", "l", "ord"),
        graph=GraphSpec("c", "l", "v", "ord"),
        hierarchy=HierarchySpec(["l1", "l2", "l3"], "v", "ord"),
    )
    return spark, data, board


def first_seen(names):
    return {name: i for i, name in enumerate(dict.fromkeys(names))}


def test_links(case):
    _, data, board = case
    place = first_seen(r[1] for r in data)
    cells = Counter()
    for _, source, _, targets, *_ in data:
        for target in targets or []:
            if target in place:
                cells[source, target] += 1
                cells[target, source] += 1
    assert {(a, b): v for a, b, v in rows(board.link_matrix(), "source", "target", "value")} == cells

    total = {name: sum(v for (a, _), v in cells.items() if a == name) for name in place}
    scale = (2 * math.pi - 0.05 * len(place)) / sum(total.values())
    start, arcs, offsets = 0.0, {}, {}
    for name in place:
        arcs[name] = (start, start + total[name] * scale)
        start = arcs[name][1] + 0.05
        before = 0
        for other in sorted((b for a, b in cells if a == name), key=lambda b: (-cells[name, b], place[b])):
            offsets[name, other] = before
            before += cells[name, other]
    got = {e: (s, t) for e, s, t in rows(board.arcs(), "entity", "start", "end")}
    assert set(got) == set(arcs) and all(got[e] == pytest.approx(arcs[e]) for e in arcs)
    sub = board.subarcs()
    assert {(a, b): o for a, b, o in rows(sub, "source", "target", "offset")} == offsets
    for r in board.ribbons().collect():
        assert place[r["source"]] <= place[r["target"]]
        assert r["source_start"] == pytest.approx(arcs[r["source"]][0] + offsets[r["source"], r["target"]] * scale)
        assert r["target_start"] == pytest.approx(arcs[r["target"]][0] + offsets[r["target"], r["source"]] * scale)


def test_graph(case):
    _, data, board = case
    values = [r[2] or 0.0 for r in data]
    low, high = min(values), max(values)
    first = {}
    for r in data:
        first.setdefault(r[1], r[2] or 0.0)
    sizes = {i: s for i, s in rows(board.nodes, "id", "size")}
    assert set(sizes) == set(first)
    assert all(sizes[i] == pytest.approx(10 + 20 * (v - low) / (high - low)) for i, v in first.items())
    expected = Counter((r[1], t) for r in data for t in r[3] or [] if r[1] and t and t in first)
    assert Counter(rows(board.graph_links, "source", "target")) == expected


def model_tree(data):
    """Path -> [value, first row], for all depths, from last-written leaves."""
    leaf, first = {}, {}
    for i, _, value, _, *path in data:
        leaf[tuple(path)] = value or 0.0
        for k in range(4):
            first.setdefault(tuple(path[:k]), i)
    return {p: (sum(v for q, v in leaf.items() if q[: len(p)] == p), first[p]) for p in first}


def test_hierarchy(case):
    _, data, board = case
    tree = model_tree(data)
    spans = {(): (0.0, 2 * math.pi)}
    for path in sorted(tree, key=lambda p: (len(p), tree[p][1])):
        edge = spans[path][0]
        for child in sorted((c for c in tree if len(c) == len(path) + 1 and c[:-1] == path), key=lambda c: tree[c][1]):
            width = 2 * math.pi * tree[child][0] / tree[()][0]
            spans[child] = (edge, edge + width)
            edge += width
    got = {tuple(r["path"]): r for r in board.laid_out_tree.collect()}
    assert set(got) == set(tree)
    for path, (value, seen) in tree.items():
        assert (got[path]["value"], got[path]["first_seen"]) == (value, seen)
        assert (got[path]["x0"], got[path]["x1"]) == pytest.approx(spans[path])


@pytest.mark.parametrize("chosen", [["p"], ["x", "m"], ["q", "nothing"]])
def test_tree_selection(case, chosen):
    spark, data, board = case
    tree = model_tree(data)
    ranks = {p: [tree[p[: k + 1]][1] for k in range(len(p))] for p in tree}
    ring_order = sorted(tree, key=lambda p: (len(p), ranks[p]))
    names = set()
    for name in chosen:
        hit = next((p for p in ring_order if p and p[-1] == name), None)
        if hit is not None:
            names.update(["root", *hit])
    lit = {
        p
        for p in tree
        if p and (p[-1] in names or any(q[: len(p)] == p and q[-1] in chosen for q in tree if len(q) >= len(p)))
    }
    flagged = selection.flag_tree(board.laid_out_tree, selection.keys(spark, chosen))
    assert {tuple(r["path"]) for r in flagged.where("lit").collect()} == lit


def test_bars(case):
    _, data, board = case
    top = max(r[2] for r in data if r[2] is not None)
    place = first_seen(r[1] for r in data)
    step = 2 * math.pi / (len(place) + 0.1)
    got = {r["ord"]: r for r in board.bars().collect()}
    for i, name, value, *_ in data:
        assert got[i]["start"] == pytest.approx(step * (place[name] + 0.1))
        expected = None if value is None else pytest.approx(math.sqrt(value / top))
        assert got[i]["length"] == expected
