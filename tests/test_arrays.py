"""One large array in many byte ranges, against json.loads."""

import json

import pytest

from viewloom.sources import arrays
from workload import queries

AWKWARD = [
    {"a": 1}, {"a": "}{][\",\\", "b": {"c": [{"d": 1}, {"e": "\\\\"}]}}, {}, {"a": "\\\"{"}, {"t": "ä é\U0001f600{"}, {"n": [[[{"x": []}]]]}, {"long": "{" * 300},
    {"q": "'\"\n\t{}"}, {"deep": {"deep": {"deep": {"deep": {}}}}},
]


@pytest.fixture
def ranges(spark):
    """Ranges of so many bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size):
        for k in kept:
            spark.conf.set(k, size)

    yield set_to
    for k, v in kept.items():
        spark.conf.set(k, v)


def texts(spark, path):
    rows = arrays.record_texts(spark, str(path)).orderBy("row_order").collect()
    return [json.loads(r.text) for r in rows]


@pytest.mark.parametrize("size", [40])
def test_records_of_many_ranges(spark, ranges, tmp_path, size):
    rows = AWKWARD
    for i, indent in enumerate((None, 2)):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=bool(i)))
    (tmp_path / "2.json").write_text("\n " + json.dumps(AWKWARD[1], indent=1) + "\n")
    (tmp_path / "3.json").write_text(" [ ] ")
    (tmp_path / "4.json").write_text("")
    ranges(size)
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert texts(spark, tmp_path) == rows + rows + [AWKWARD[1]]


@pytest.mark.parametrize("bad", ['[{"a":1}', '[{"a":1},{"b":2]', '{"a":1}{"b":2}', '[{"a":1} {"b":2}]', "[1,2]", '[{"a":1}, 5, {"b":2}]', '[{"a":"x}]', "nothing", '[{"a":1},]', '[[{"a":1}]]', '[{"a":1}]]'])
def test_malformed_files_are_refused(spark, tmp_path, bad):
    (tmp_path / "x.json").write_text(bad)
    with pytest.raises(Exception):
        arrays.read_array(spark, str(tmp_path)).collect()


def test_typed_and_variant(spark, ranges, tmp_path):
    ranges(50)
    (tmp_path / "x.json").write_text(json.dumps([{"a": i, "s": "x" * i} for i in range(30)]))
    typed = arrays.read_array(spark, str(tmp_path), "a int, s string").orderBy("row_order").collect()
    assert [(r.a, len(r.s)) for r in typed] == [(i, i) for i in range(30)]
    variants = arrays.read_array(spark, str(tmp_path)).selectExpr("variant_get(record, '$.a', 'int') AS a", "row_order").orderBy("row_order")
    assert [r.a for r in variants.collect()] == list(range(30))


def test_single_objects_share_a_folder(spark, tmp_path, monkeypatch):
    """A file per supplier, without a folder each, written by several tasks; null fields and repeated rows are kept."""
    rows = [(1, "a", 3, 1.5), (1, "a", 3, 1.5), (2, None, None, None), (None, "b", 4, 2.0), (None, None, None, None)]
    names = "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    found = queries.ingest_objects(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(rows, key=repr)
    written = [p for p in (tmp_path / "objects").rglob("*") if not p.name.startswith((".", "_"))]
    assert len(written) == len(rows) and all(p.is_file() and p.parent == tmp_path / "objects" for p in written)
    assert len({p.name[: len("part-00000")] for p in written}) > 1
