"""The registered queries on a small folder of tables, against SQL or a plain version."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, by_id, documents, prose
from tests.llm.test_crf import junk, speech
from tests.llm.test_secrets import base
from tests.llm.test_simhash import classes, fingerprint
from tests.llm.test_urls import URLS
from viewloom.llm import secret_scan
from viewloom.llm.sql import ORACLE
from viewloom.llm.vocabulary import Vocabulary
from viewloom.llm.workload import QUERIES

TEXTS = [*AWKWARD, *[prose(s, 60) + ".\n" + prose(s, 20) for s in range(30)], *map(junk, range(30)), "token = \"" + "0f" * 20 + "\"",
         *[speech("yy", s, 40) for s in range(20)]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    lang = F.when(F.col("doc_id") < 72, F.when(F.col("doc_id") != 5, "xx")).otherwise("yy")
    documents(spark, TEXTS).withColumn("lang", lang).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 42), 0) for i in range(12, 72) if i % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    pages = [(i, url, None) for i, url in enumerate(URLS)]
    pages += [(100, "http://q.info/a", "<link rel='canonical' href='http://q.example.com/de/'>"), (101, "http://r.info/", "x"),
              (102, "http://r.info/b#t", '<meta http-equiv="refresh" content="1;url=/c">'), (103, "http://r.info/c", "<link href=//w.org/fr/ rel=canonical>"),
              (104, "http://rel.info/x/a", "<link rel='canonical' href='../y/2'>"), (105, "http://rel.info/y/2", '<link rel="alternate canonical" href="http://q.example.com/de/k">'),
              (106, "http://amp.info/p?a=1", "<link rel=canonical href='?a=1&amp;b=2'>"), (107, "http://amp.info/p?a=1&b=2", "<link rel=canonical href='http://z.net/'>"),
              (108, "http://dots.info/a/./b/../c", "x"), (109, "http://dots.info/z", "<link rel=canonical href=a/c>"), (110, "http://dots.info/a/c", "<link rel=canonical href='http://z.net'>"),
              (111, "http://own.info", "<link rel=canonical href='#top'><link rel=canonical href='mailto:a@b.net'><link rel=noncanonical href='http://z.net/'>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 3 if t > 1 else 'all'}") for c in range(18, 64) for t in range(c % 6)]
    turns += [(100, None, "user", None), (100, 0, "", "a b"), (101, 3, "user", "x"), (111, 0, "user", "lost base")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def ids(i, parts):
    return zlib.crc32(str(i).encode()) % parts


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, folder)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


def test_classifiers(spark, folder):
    quality = by_id(QUERIES["op3_quality_classifier"](spark, folder))
    assert len(quality) == len(TEXTS)
    for i, r in quality.items():
        assert r.held_out == (ids(i, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert all(quality[i].predicted == (i < 42) for i in range(12, 72))
    language = by_id(QUERIES["op4_language_id"](spark, folder))
    assert len(language) == len(TEXTS)
    for i, r in language.items():
        assert r.held_out == (ids(i, 3) == 1) and (r.lang_pred == "und") == (not any(map(str.isalpha, TEXTS[i] or "")))
    assert all(language[i].lang_pred == ("xx" if i < 42 else "yy") for i in [*range(12, 42), *range(73, len(TEXTS))])


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, folder, tmp_path):
    """Turned labels in the held-out folds, and new lang and source values, change no score."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lang = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, "zz").otherwise(F.col("lang"))
    docs.withColumns({"lang": lang, "source": F.lit("other")}).write.parquet(f"{tmp_path}/documents.parquet")
    turned = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    labels.withColumn("quality", turned).write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op3_quality_classifier", "op4_language_id"):
        assert by_id(QUERIES[name](spark, folder)) == by_id(QUERIES[name](spark, str(tmp_path)))


def test_secrets(spark, folder):
    for i, r in by_id(QUERIES["op5_secret_scan"](spark, folder)).items():
        spans = base(TEXTS[i])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in spans) for kind in secret_scan.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (r.n_random or r.spans == joined)


def test_near_duplicates(spark, folder):
    got = by_id(QUERIES["op6_simhash"](spark, folder))
    prints = {i: fingerprint(t, 3) for i, t in enumerate(TEXTS)}
    want = classes(range(len(TEXTS)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_tokens(spark, folder):
    encoding = Vocabulary().encoding()
    for i, r in by_id(QUERIES["op8_bpe"](spark, folder)).items():
        tokens = encoding.encode_ordinary(TEXTS[i] or "")
        assert r.n_tokens == len(tokens) and r.ids_sha256 == hashlib.sha256(",".join(map(str, tokens)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()


def test_scores(spark, folder):
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(TEXTS)}
    c = Counter(w for i, some in words.items() if ids(i, 10) for w in some)
    n, v = sum(c.values()), len(c)
    got = by_id(QUERIES["op9_lm_score"](spark, folder))
    for i, some in words.items():
        assert (got[i].held_out, got[i].n_tokens, got[i].train_tokens) == (ids(i, 10) == 0, len(some), n)
        assert got[i].n_known == sum(c[w] > 0 for w in some) and got[i].score < 0
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in some), rel_tol=1e-9)


def test_packing(spark, folder):
    encoding = Vocabulary().encoding()
    packed = QUERIES["op10_packing"](spark, folder)
    sizes = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert sizes == {i: len(encoding.encode_ordinary(t or "")) + 1 for i, t in enumerate(TEXTS)}
    assert packed.groupBy("pack", "bin").agg(F.sum("length").alias("n"), F.min("capacity").alias("c")).where("n > c").count() == 0
