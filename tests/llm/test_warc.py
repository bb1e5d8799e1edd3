"""Archives: records as written, as members of their own, and as read again; against plain loops and the gzip module."""

import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import warc as W
from weftline.llm.common import table

KIND = "page_id long, url string, html string"


def pages(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(r.choice("ab é<>\r\n") for _ in range(r.choice([0, 5, 99, 100, 101, 3000]))) if r.random() < 0.6 or not out else r.choice(out)[2]
        out.append((i, r.choice([None, f"http://x.example/{i}?a b", "http://é.example/\r\nX: y"]), text if r.random() < 0.95 else None))
    r.shuffle(out)
    return out


def plain(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = len(b) >= 100 and first[b] != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = pages(1, 400)
    folder = tmp_path_factory.mktemp("warc")
    index, at = W.archive(spark.createDataFrame(rows, KIND).repartition(3), f"file://{folder}")
    return rows, index, at, folder


def test_equals_plain_loops(made):
    rows, index, at, _ = made
    assert sorted(tuple(r) for r in W.read_records(index, at).collect()) == plain(rows)


def test_each_record_is_a_member_where_the_index_says(made):
    rows, index, _, folder = made
    seen = 0
    for f in sorted((folder / "warc").iterdir()):
        data, end = f.read_bytes(), 0
        for r in index.filter(index.file == f.name).orderBy("offset").collect():
            assert r.offset == end
            end += r.length
            raw = gzip.decompress(data[r.offset : end])
            assert raw.startswith(W.VERSION) and raw.count(W.VERSION) == 1
            head = W.parsed(raw[: raw.index(W.END) + 4])
            assert head["warc-type"] == r.record_type and head.get("x-page-id") == (None if r.page_id is None else str(r.page_id))
            assert (r.record_type == "revisit") == ("warc-refers-to" in head)
            seen += 1
        assert end == len(data)
    assert seen == len(rows)


def test_revisits_name_the_record_that_has_the_payload(made):
    _, index, _, folder = made
    heads = []
    for f in sorted((folder / "warc").iterdir()):
        data = f.read_bytes()
        for r in index.filter(index.file == f.name).collect():
            raw = gzip.decompress(data[r.offset : r.offset + r.length])
            heads.append(W.parsed(raw[: raw.index(W.END) + 4]))
    ids = {h["warc-record-id"]: h for h in heads}
    assert len(ids) == len(heads)
    again = [h for h in heads if h["warc-type"] == "revisit"]
    assert again and all(ids[h["warc-refers-to"]]["warc-payload-digest"] == h["warc-payload-digest"] and ids[h["warc-refers-to"]]["warc-type"] == "response" for h in again)


def test_a_stream_is_one_member_and_read_once(spark, tmp_path):
    """What is written first can only be read from its start; the normaliser makes the same records of it, without changes too."""
    rows = [(i, "u", f"{i} " * 100) for i in range(50)]
    raw = W.write_streams(spark.createDataFrame(rows, KIND).coalesce(1), f"file://{tmp_path}/s", most=6000).select("file", "page_id").collect()
    files = {r.file for r in raw}
    assert len(files) > 2 and {r.page_id for r in raw} == set(range(50))
    for f in files:
        d = (tmp_path / "s" / f).read_bytes()
        z = zlib.decompressobj(31)
        z.decompress(d)
        assert z.eof and not z.unused_data
    index = W.normalised(spark.createDataFrame([(f,) for f in files], "file string"), f"file://{tmp_path}/s", f"file://{tmp_path}/n")
    index.write.parquet(f"{tmp_path}/i")
    got = W.read_records(spark.read.parquet(f"{tmp_path}/i"), f"file://{tmp_path}/n").collect()
    assert sorted(tuple(r) for r in got) == plain(rows)


def test_odd_rows(spark):
    long = "x" * 9_000_000
    rows = [(1, None, None), (2, "", ""), (3, "u", long), (4, "u", long), (None, "u", long), (5, "u", "y" * 200), (5, "u", "y" * 200), (None, None, "z" * 100), (None, None, "z" * 100), (6, "u", "s"), (7, "u", "s")]
    got = sorted((tuple(r) for r in W.round_trip(spark.createDataFrame(rows, KIND).withColumn("file", F.lit(1))).collect()), key=str)
    of = lambda i: sorted(((t, r) for p, _, _, t, r in got if p == i), key=str)
    assert len(got) == len(rows)
    assert of(3) == [("response", None)] and of(4) == [("revisit", 3)] and of(1) == of(2) == of(6) == of(7) == [("response", None)]
    assert of(5) == [("response", None), ("revisit", 5)]
    assert of(None) == sorted([("revisit", 3), ("response", None), ("revisit", None)], key=str)
    assert next(n for p, n, *_ in got if p == 4) == len(long)


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    index, at = W.archive(empty)
    assert index.collect() == [] and W.read_records(index, at).collect() == []


def test_a_damaged_record_is_told(made):
    _, index, _, folder = made
    r = index.filter("record_type = 'response'").orderBy("file", "offset").first()
    raw = gzip.decompress((folder / "warc" / r.file).read_bytes()[r.offset : r.offset + r.length])
    with pytest.raises(ValueError, match="isn't what was written|doesn't end"):
        body = raw.index(W.END, raw.index(W.END) + 4) + 4
        W.read_member(gzip.compress(raw[:body] + b"#" + raw[body:]))


def test_of_a_real_table(spark):
    p = table(spark, "/root/testdata/sf0.001", "pages")
    assert sorted(tuple(r) for r in W.round_trip(p).collect()) == plain([(r.page_id, r.url, r.html) for r in p.collect()])
