from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThanOrEqual

from weftline.operators import providers
from weftline.plans import rules
from weftline.sources import paged, sheets, tables
from weftline.streaming import resume, state


def test_workbook_round_trip():
    rows = [["a", None, 3], ["<&>", "  spaced ", 2.5], []]
    assert list(sheets.workbook_rows(sheets.workbook(rows))) == [["a", None, "3"], ["<&>", "  spaced ", "2.5"], []]


def test_demand(spark, tmp_path):
    (tmp_path / "one.xlsx").write_bytes(sheets.workbook([["Report of June"], ["x", "كود الصنف", "اسم الصنف", " الكمية "], [0, "10.0", "Drug A", "2.5"], [0, "", "", 9], [0, "11", "Drug B", 0], [0, "12", "Drug C", "3.5"]]))
    (tmp_path / "two.xlsx").write_bytes(sheets.workbook([["name", "code"], ["Drug D", 5]]))
    got = sorted((r.code, r.name, r.qty) for r in sheets.read_demand(spark, str(tmp_path / "one.xlsx"), most=3).collect())
    assert got == [("10", "Drug A", 2), ("12", "Drug C", 3)]
    got = sorted((r.code, r.name, r.qty) for r in sheets.read_demand(spark, str(tmp_path), match_only=True).collect())
    assert got == [("10", "Drug A", 1), ("11", "Drug B", 1), ("12", "Drug C", 1), ("5", "Drug D", 1)]


def test_text_tables(spark, tmp_path):
    d = spark.createDataFrame([("ä,b", 'q"q', 1, "hid"), (None, "x\ny", 2, "hid")], "a string, b string, c int, _d string")
    tables.write_text_table(d.coalesce(1), str(tmp_path / "t"))
    got = tables.read_text_table(spark, str(tmp_path / "t"))
    assert got.columns == ["a", "b", "c"] and sorted(r.c for r in got.collect()) == ["1", "2"]
    assert sorted(r.b for r in got.collect()) == ['q"q', "x\ny"]
    (tmp_path / "bom.csv").write_bytes("﻿code,name\n1,x\n".encode())
    assert tables.read_text_table(spark, str(tmp_path / "bom.csv")).columns == ["code", "name"]
    tables.append_evolving(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "e"))
    tables.append_evolving(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "e"))
    assert sorted(tuple(r) for r in tables.read_evolving(spark, str(tmp_path / "e")).select("a", "b").collect()) == [(1, None), (2, "x")]


def test_worker_parts(spark, tmp_path):
    (tmp_path / "part_2.csv").write_text("a,b\n1,2\n")
    (tmp_path / "part_10.csv").write_text("a,c\n3,4\n")
    got = tables.merge_worker_parts(spark, [str(tmp_path / "part_2.csv"), str(tmp_path / "part_10.csv")])
    assert sorted((r.worker, r.a, r.b, r.c) for r in got.collect()) == [(2, "1", "2", None), (10, "3", None, "4")]
    assert tables.newest_file(spark, [str(tmp_path)]).endswith(".csv")


def test_decisions(spark):
    schema = "item_code_key string, item_name_key string, item_code string, item_name string, approved int, correct_store_product_id string, created_at string, seq long"
    old = spark.createDataFrame([("1", "A", "1", "a", 0, None, "t0", 1)], schema)
    new = spark.createDataFrame([("1", "A", "1.0", "A!", 1, "55", "t1", 2), ("2", "B", "2", "b", 1, "nan", "t1", 3)], schema)
    saved = tables.save_decisions(old, new)
    assert sorted((r.item_code, r.item_name, r.approved, r.created_at) for r in saved.collect()) == [("1", "a", 1, "t0"), ("2", "b", 1, "t1")]
    assert [r.item_code_key for r in tables.accepted_hints(saved).collect()] == ["1"]
    assert tables.query_fan_out(spark).count() == 62


@pytest.mark.parametrize("payload,names", [('[{"productName": "a"}]', ["a"]), ('{"data": [{"x": 1}, {"productNameEn": "b"}]}', ["b"]), ('{"data": {"items": [{"productName": "c"}]}}', ["c"]), ("{}", []), ("bad", [])])
def test_payloads(spark, payload, names):
    d = tables.payload_rows(spark.createDataFrame([(payload,)], "p string"), "p")
    assert [r.name_ar or r.name_en for r in d.collect()] == names


def test_streams_equal_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(6).write.parquet(str(tmp_path / "in"))
    schema = events._jdf.schema().toDDL()
    live = state.new_files(spark, str(tmp_path / "in"), schema, files_a_batch=2)
    got = state.drain(state.last_states(live, ["user_id"], "event_id", ["event_type", "value"]), "last_states", str(tmp_path / "c1"))
    want = state.last_states(events, ["user_id"], "event_id", ["event_type", "value"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ok = live.select("user_id", (F.col("event_type") != "error").alias("ok"))
    got = state.drain(state.disabled_stream(ok, ["user_id"]), "disabled", str(tmp_path / "c2"), "append")
    want = events.filter("event_type = 'error'").groupBy("user_id").count().filter("count >= 2")
    assert sorted(r.user_id for r in got.collect()) == sorted(r.user_id for r in want.collect())


def test_stream_of_failures_equals_its_batch(spark, tmp_path):
    """Files in no order of time, failures at one time, long waits; when all waits are over nothing is left in the state."""
    events = rules.attempts_of(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    odd = [(1, None, False, None), (None, datetime(2024, 1, 1), False, 70), (1, datetime(2024, 1, 1), None, 90), (2, datetime(2024, 1, 1), False, None), (2, datetime(2024, 1, 1), False, None), (2, datetime(2024, 1, 1, 0, 0, 1), False, None)]
    events = events.unionByName(spark.createDataFrame(odd, events.schema))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(0, datetime(2090, 1, 1), True, None)], events.schema).write.parquet(str(tmp_path / "end"))
    want = providers.timed_out(events, ["model"], "ts", 3, 86_400, 7_200)
    live = state.new_files(spark, f"{tmp_path}/in", events._jdf.schema().toDDL(), files_a_batch=1)
    got = state.timed_out_stream(live, ["model"], "ts", 3, 86_400, 7_200, late="100000 days")
    run = lambda d, mode="append": d.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run(got).awaitTermination()
    for f in (tmp_path / "end").glob("part-*"):
        f.rename(tmp_path / "in" / f.name)
    live = state.new_files(spark, f"{tmp_path}/in", events._jdf.schema().toDDL())
    q = run(state.timed_out_stream(live, ["model"], "ts", 3, 86_400, 7_200, late="1 day"))
    q.awaitTermination()
    rows = lambda d: sorted(map(str, d.select("model", "at", "failures", "until").collect()))
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(want) and want.count() > 20
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_workbooks_are_written_by_tasks(spark, tmp_path):
    """Above one sheet's rows: several workbooks, each with its header, in order, none hidden left."""
    d = spark.range(1000).selectExpr("id", "concat('n', id) as name", "if(id % 7 = 0, null, id) as qty")
    sheets.write_workbooks(d, f"file://{tmp_path}/w", above=[["Title"]], order=[F.col("id")], most_rows=102)
    files = sorted(p.name for p in (tmp_path / "w").iterdir())
    assert len(files) >= 10 and not any(f.startswith("_") for f in files)
    seen = []
    for f in files:
        rows = list(sheets.workbook_rows((tmp_path / "w" / f).read_bytes()))
        assert rows[:2] == [["Title"], ["id", "name", "qty"]] and len(rows) <= 102
        seen += [int(r[0]) for r in rows[2:]]
    assert seen == list(range(1000))
    got = sheets.read_demand(spark, str(tmp_path / "w"), match_only=True)
    assert got.count() == 0  # no code column
    sheets.write_workbooks(d.selectExpr("id as code", "name"), f"file://{tmp_path}/v", most_rows=300)
    assert sheets.read_demand(spark, str(tmp_path / "v"), match_only=True).agg(F.sum("qty"), F.countDistinct("code")).first()[:] == (1000, 1000)


def test_failed_workbooks_leave_nothing(spark, tmp_path):
    bad = F.udf(lambda k: 1 // (k - 900), "long")
    with pytest.raises(Exception, match="division|ZeroDivision"):
        sheets.write_workbooks(spark.range(1000).select(bad("id").alias("x")), f"file://{tmp_path}/w", order=[F.col("x")])
    assert not list((tmp_path / "w").glob("part*")) if (tmp_path / "w").exists() else True


def test_pages_that_are_read(spark, tmp_path):
    """Ranges stop at their first empty page; equalities and bounds leave out what they can before anything is read."""
    full, empty = '{"data": [{"productName": "a"}]}', '{"data": []}'
    rows = [("a b", p, full) for p in range(11)] + [("c", p, full if p != 2 else empty) for p in range(9)] + [("d/%é", 0, full), ("e", 0, empty)]
    spark.createDataFrame(rows, "query string, page int, payload string").write.partitionBy("query", "page").text(f"{tmp_path}/p")
    every = paged.stored_pages(spark, f"file://{tmp_path}/p", pages_a_task=4, most_pages=16)
    got = {q: sorted((r.page, r.listed) for r in every.collect() if r.query == q) for q in ("a b", "c", "d/%é", "e")}
    assert got["a b"] == [(p, 1) for p in range(11)] + [(11, 0), (12, 0)]  # the end, and one look at the range behind it
    assert got["c"] == [(0, 1), (1, 1), (2, 0), (4, 1), (5, 1), (6, 1), (7, 1), (8, 1), (9, 0), (12, 0)]  # page 3 is never read
    assert got["d/%é"][:2] == [(0, 1), (1, 0)] and got["e"][0] == (0, 0)
    kept = paged.before_the_end(every)
    assert sorted((r.query, r.page) for r in kept.collect()) == sorted([("a b", p) for p in range(11)] + [("c", 0), ("c", 1), ("d/%é", 0)])
    some = every.filter("query = 'a b' and page >= 4 and page < 7")
    assert sorted(r.page for r in some.collect()) == [4, 5, 6] and some.rdd.getNumPartitions() == 1
    reader = paged.StoredPagesReader({"path": f"file://{tmp_path}/p", "pagesATask": "4", "mostPages": "16"})
    left = list(reader.pushFilters([EqualTo(("query",), "c"), LessThanOrEqual(("page",), 5), EqualTo(("payload",), "x")]))
    assert left == [EqualTo(("payload",), "x")] and [(p.query, p.start, p.stop) for p in reader.partitions()] == [("c", 0, 4), ("c", 4, 6)]


@pytest.mark.parametrize("text,n", [("[1, 2]", 2), ('{"items": [1]}', 1), ('{"data": {"rows": [1, 2, 3]}}', 3), ('{"data": [], "items": [1]}', 1), ("{}", 0), ("", 0), ("bad", 0), ("3", 0)])
def test_listed(text, n):
    assert paged.listed(text) == n


def test_merged_texts(spark, tmp_path):
    for name, text in (("b", "two\n"), ("a", "one\nmore\n"), ("c", ""), ("d", "é\n\n"), ("e", "end\n")):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "part.txt").write_text(text)
    m = tables.merge_texts(spark, f"file://{tmp_path}/in")
    assert [(r.start, r.text) for r in m.orderBy("start", "path").collect()] == [(0, "one\nmore\n"), (9, "two\n"), (13, "é\n\n"), (17, "end\n")]
    tables.write_merged(m, f"{tmp_path}/out")
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == "one\nmore\ntwo\né\n\nend\n"


def test_a_run_that_is_stopped_goes_on(spark, tmp_path, monkeypatch):
    """Stopped between data and manifest, and between manifest and checkpoint: each row is there once, whatever is replayed."""
    schema = "user_id long, event_id long"
    spark.range(300).selectExpr("id % 7 as user_id", "id as event_id").repartition(6).write.parquet(f"{tmp_path}/in")
    table, at = f"file://{tmp_path}/t", f"file://{tmp_path}/c"
    go = lambda then=None: resume.run(state.new_files(spark, f"{tmp_path}/in", schema, files_a_batch=2), table, at, then)
    real = resume._named

    def stopped(spark_, table_, batch, folder):
        if batch == 1:
            raise RuntimeError("stopped before the manifest")
        real(spark_, table_, batch, folder)

    monkeypatch.setattr(resume, "_named", stopped)
    with pytest.raises(Exception, match="stopped before"):
        go().awaitTermination()
    assert resume.progress(spark, table).count() == 1 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    monkeypatch.setattr(resume, "_named", real)

    def late(batch):
        if batch == 1:
            raise RuntimeError("stopped before the checkpoint")

    with pytest.raises(Exception, match="stopped before"):
        go(late).awaitTermination()
    assert resume.progress(spark, table).count() == 2
    go().awaitTermination()
    rows = resume.read(spark, table, schema)
    assert sorted(r.event_id for r in rows.collect()) == list(range(300))
    assert sorted((r.batch, r.n) for r in rows.groupBy("batch").agg(F.count("*").alias("n")).collect()) == sorted((r.batch, r.rows) for r in resume.progress(spark, table).collect())
    assert sorted((r.user_id, r.event_id) for r in resume.latest(spark, table, schema, ["user_id"], "event_id").collect()) == [(u, max(range(u, 300, 7))) for u in range(7)]
    go().awaitTermination()
    assert resume.read(spark, table, schema).count() == 300 and resume.progress(spark, f"{table}/none").count() == 0
