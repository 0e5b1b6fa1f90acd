"""The pipeline's stages on a small table, against what each is to keep."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.frames import SCHEMA, documents, prose
from tests.llm.test_crf import junk
from tests.llm.test_simhash import edited, jaccard
from viewloom.llm import secret_scan, workload
from viewloom.llm.vocabulary import Vocabulary
from viewloom.operators.staging import stored


def corpus():
    """Ids 0-59 good, 60-89 junk, then exact copies, near copies and secrets."""
    good = [prose(s, 120, 3000) + ".\n" + prose(s + 500, 80, 3000) + "." for s in range(60)]
    bad = [junk(s) + "\n" + junk(s + 3) for s in range(30)]
    exact = [good[3], good[3], good[4]]
    near = [edited(good[k], k, 0.01) for k in range(10, 20)]
    secret = [prose(900, 100, 3000) + " token = \"" + "0123456789abcdef" * 2 + "\" " + prose(901, 30, 3000)]
    return good, bad, exact, near, secret


NAMELESS = prose(950, 90, 3000) + "."


def write(spark, folder):
    """Besides the corpus: rows without an id, of which two are alike, and one without a text."""
    texts = [t for part in corpus() for t in part]
    more = spark.createDataFrame([(None, None, None, None, None), (None, NAMELESS, None, None, 1), (None, NAMELESS, "en", None, 1)], SCHEMA)
    documents(spark, texts).union(more).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(not 60 <= i < 90), 0) for i in range(90)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_stages(spark, tmp_path, monkeypatch):
    texts = write(spark, tmp_path)
    shown = {}

    def watched(name, stage):
        def run(spark, docs, sf_dir):
            out = stage(spark, docs, sf_dir)
            shown[name] = stored(out)
            return shown[name]

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*stage) for stage in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    assert all(df.columns == columns for name, df in shown.items() if name != "packing")
    rows = {name: df.collect() for name, df in shown.items()}
    assert sorted(map(tuple, packed.collect()), key=repr) == sorted(map(tuple, rows["packing"]), key=repr)
    seen = {name: {r.doc_id for r in found} - {None} for name, found in rows.items()}
    assert seen["quality"] == set(range(len(texts))) - set(range(60, 90))
    least = {}
    for i in sorted(seen["quality"]):
        least.setdefault(texts[i], i)
    assert seen["exact"] == set(least.values())
    copies = {b for b in seen["exact"] for a in seen["exact"] if a < b and jaccard(texts[a], texts[b]) >= 0.8}
    assert len(copies) == 10 and seen["near"] == seen["exact"] - copies
    assert seen["secrets"] == seen["near"] == seen["packing"]
    nameless = {name: [r.text for r in found if r.doc_id is None] for name, found in rows.items() if name != "packing"}
    assert nameless["quality"].count(NAMELESS) == 2
    assert all(nameless[name].count(NAMELESS) == 1 for name in ("exact", "near", "secrets"))
    clean = {r.doc_id: r for r in rows["secrets"] if r.doc_id is not None}
    last = max(clean)
    assert "0123456789abcdef" not in clean[last].text and clean[last].n_chars == len(clean[last].text)
    assert all(clean[i].text == texts[i] for i in clean if i != last)
    encoding = Vocabulary().encoding()
    sizes = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert all(sizes[i] == len(encoding.encode_ordinary(r.text)) + 1 for i, r in clean.items())


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_cover_the_operators():
    assert sorted(int(name[2:].split("_")[0]) for name in workload.QUERIES) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "secrets", "packing"]
    assert secret_scan.KINDS[:3] == ["assign", "access", "hex"]
