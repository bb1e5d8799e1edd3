"""Every query of this subpackage on the smallest tables: its SQL where there is one, contracts where there is none."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, odd_rows
from weftline.llm.common import crc_mod, table
from weftline.llm.queries import ORACLE, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
CONTRACT = {
    1: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    2: "doc_id n_shingles component_id kept",
    4: "doc_id size source_size target taken",
    6: "doc_id n_words n_removed kept_sha256",
    7: "doc_id held_out n_tokens n_known train_tokens base_score score",
    8: "doc_id n_words n_hit n_items items_sha256 contaminated",
    9: "doc_id start n_tokens ids_crc32",
    10: "doc_id held_out lang_pred score",
    11: "vec_id code error label_error codebooks_sha256",
    12: "page_id payload_bytes payload_digest record_type refers_to",
    13: "vec_id cluster distance cluster_inertia inertia centroid_sha256",
}
#: The table whose rows the result has one by one, if not documents.
OF = {11: "embeddings", 12: "pages", 13: "embeddings"}
TABLES = ("documents", "benchmark", "labels", "embeddings", "pages")


def rows_of(name):
    return OF.get(int(name[2:].split("_")[0]), "documents")


def canon(rows):
    one = lambda v: "NULL" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, name):
    df = QUERIES[name](spark, SF)
    n = int(name[2:].split("_")[0])
    assert n not in CONTRACT or df.columns[: len(CONTRACT[n].split())] == CONTRACT[n].split() or set(CONTRACT[n].split()) <= set(df.columns)
    assert df.count() == table(spark, SF, rows_of(name)).count()


def test_there_are_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables with every odd case and columns whose names clash with the operators' own."""
    at = tmp_path_factory.mktemp("odd")
    clash = {c: F.lit(1) for c in ("key", "row", "size", "rank", "target", "score", "words", "hits", "items", "kept", "grade", "comp", "id", "bin", "copies", "shard")}
    more = {c: F.lit(1) for c in ("v", "n", "code", "error", "cluster", "distance", "file", "ordinal", "payload", "first", "key_of", "size")}
    d = documents(spark, [(*r, "en" if i % 2 else None, None if i % 3 else "s") for i, r in enumerate(odd_rows())]).withColumns(clash)
    d.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, None, None), (6, 0, 1), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int").withColumns(clash).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "no id here"), (2, None), (None, "w1 w2"), (3, "")], "item_id long, text string").withColumns(clash).write.parquet(f"{at}/benchmark.parquet")
    vectors = [(1, [0.5] * 64, 1), (2, [0.5] * 64, None), (2, [0.5] * 64, 1), (None, [-0.25] * 64, 2)]
    spark.createDataFrame([*vectors, (3, None, 1), (4, [], 1), (5, [float("nan")] * 64, 1), (6, [None] * 64, 1)], "vec_id long, embedding array<float>, label int").withColumns(more).write.parquet(f"{at}/embeddings.parquet")
    spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "x" * 500), (3, "u", "x" * 500), (None, "u", "x" * 500)], "page_id long, url string, html string").withColumns(more).write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        table(spark, SF, t).limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, name, odd_dir, empty_dir):
    n = {"documents": len(odd_rows()), "embeddings": 4, "pages": 5}[rows_of(name)]
    assert len(QUERIES[name](spark, odd_dir).collect()) == n
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_stages_on_odd_and_empty_tables(spark, odd_dir, empty_dir):
    for d in (odd_dir, empty_dir):
        docs = table(spark, d, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()


def test_token_files_round_trip(spark):
    """Against the tokenizer itself, text by text."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    rows = sorted((r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect())
    want, start = [], 0
    for doc, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op9_token_files"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    n, right = got.filter("held_out and lang is not null").agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).first()
    assert n > 100 and right > 0.95 * n


def test_quality_on_held_out_labels(spark):
    """Learned from two thirds of the labels. A third of the toxic labels have nothing in the text to tell them by."""
    from weftline.llm import quality_classifier as qc

    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").withColumn("out", crc_mod(F.col("doc_id"), 3) == 0)
    got = qc.score(table(spark, sf, "documents"), labels.filter("not out").drop("out")).join(labels.filter("out"), "doc_id").withColumn("kept", F.col("tail_probability") >= qc.LEAST_TAIL)
    r = {(x.quality, x.toxic): x.kept for x in got.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert r[1, 0] > 0.98 and r[0, 0] < 0.15 and r[1, 1] < 0.15
