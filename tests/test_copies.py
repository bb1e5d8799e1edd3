"""Tables whose rows repeat names: names, not rows, are judged; and places of lines that files are dealt by size."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import allocate as A
from weftline.operators import blocking as B
from weftline.operators import contained as C
from weftline.plans.queries import QUERIES
from weftline.sources import tables as T
from weftline.streaming import resume

COPIES = 300


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Two names of one block, and 300 rows of each."""
    folder = str(tmp_path_factory.mktemp("copies"))
    p = spark.range(2 * COPIES).select(
        F.col("id").alias("p_partkey"),
        F.when(F.col("id") % 2 == 0, "red bolt").otherwise("red ring").alias("p_name"),
        F.lit("Brand#1").alias("p_brand"),
        F.lit("LARGE").alias("p_type"),
        F.lit(5).alias("p_size"),
        (900.0 + F.floor(F.col("id") / 2) % 7).alias("p_retailprice"),
    )
    p.write.parquet(f"{folder}/part.parquet")
    return folder


def nodes(plan):
    """All nodes of a plan that has run."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        yield from nodes(plan.executedPlan())
    elif "QueryStage" in name:
        yield from nodes(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def most_joined(df):
    """The most rows that any join of the plan gave."""
    rows = df.collect()
    joins = [n for n in nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName()]
    return rows, max(n.metrics().apply("numOutputRows").value() for n in joins)


@pytest.mark.parametrize("name", ["link_best_match", "link_decisions", "token_overlap_scores", "extra_numeric_gate", "lexical_penalties"])
def test_names_are_paired_once(spark, copies, name):
    rows, joined = most_joined(QUERIES[name](spark, copies))
    assert len(rows) == (2 * COPIES if name.startswith("link") else 4 * COPIES**2)
    assert joined <= 2 * COPIES  # 360,000 when rows were paired
    if name == "link_best_match":
        assert {(r.item_id % 2, r.row_id) for r in rows} == {(0, 0), (1, 1)}
    if name == "link_decisions":
        assert all(r.ambiguous and r.candidates == 2 * COPIES for r in rows)


def test_lists_of_ids_are_bounded_and_whole(spark):
    d = spark.range(1000).select("id", F.when(F.col("id") > 900, F.lit("a")).alias("k"))
    rows = B.grouped_ids(d, ["k"], "id", "ids", 50).collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(1000))
    assert all((r.k == "a") == (i > 900) for r in rows for i in r.ids)
    assert max(len(r.ids) for r in rows) < 150


def descendants(plan):
    for i in range(plan.children().size()):
        yield plan.children().apply(i)
        yield from descendants(plan.children().apply(i))


@pytest.mark.parametrize("name", ["token_overlap_scores", "extra_numeric_gate", "lexical_penalties"])
def test_pairs_of_lists_are_not_held_whole(spark, copies, name):
    """Before the first row is out, a task has made the rows of one id, not of all ids of a list; and the rows are all there."""
    df = QUERIES[name](spark, copies)
    first = df.limit(1)
    assert len(first.collect()) == 1
    made = max(n.metrics().apply("numOutputRows").value() for n in nodes(first._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate")
    assert 0 < made <= 2 * COPIES  # 90,000 for two lists of 300
    assert df.distinct().count() == df.count() == 4 * COPIES**2


@pytest.mark.parametrize("name", ["token_overlap_scores", "extra_numeric_gate"])
def test_names_are_normalised_once(spark, copies, name):
    """In the plan all that normalises names stands in or above an aggregate."""
    plan = QUERIES[name](spark, copies)._jdf.queryExecution().optimizedPlan()
    own = [n for n in descendants(plan) if "[^A-Z0-9]+" in n.expressions().toString()]
    assert len(own) >= 2
    assert all("Aggregate" in (c.nodeName() for c in (n, *descendants(n))) for n in own)


@pytest.mark.parametrize("name", ["parse_components", "component_key_sizes", "parse_names_full", "candidate_lines", "match_confidence", "safe_omissions"])
def test_names_are_parsed_once(spark, copies, name):
    """The widest step is behind a distinct: in the plan parsing stands above an aggregate."""
    p = QUERIES[name](spark, copies)._jdf.queryExecution().optimizedPlan().toString()
    parsing = next(line for line in p.splitlines() if "_ends" in line or "_stops" in line)
    assert "Aggregate" in p[p.index(parsing) :]


def test_last_line_by_file_and_place(spark, tmp_path):
    """A short file after a long one: tasks read the long one last or first by size, but the later file holds."""
    for k, n in ((0, 3), (1, 400), (2, 1)):
        lines = "".join(f'{{"item_code": "c", "item_name": "n", "line": {1000 * k + i}}}\n' for i in range(n))
        (tmp_path / f"part-0000{k}-x.json").write_text(lines)
    assert [r.line for r in T.last_candidates(spark, str(tmp_path)).collect()] == [2000]


def test_price_delta_rounds_as_printf(spark):
    pairs = [(200.0, 200.5), (1000.0, 1002.5), (400.0, 403.0), (800.0, 806.0), (16.0, 16.125), (16.0, 16.375), (3.0, 2.0), (7.0, 123456.7), (2000.0, 2001.0), (9.0, 9.35)]
    d = spark.createDataFrame(pairs, "a double, b double").select("a", "b", A.price_delta(F.col("a"), F.col("b")).alias("x"))
    for a, b, x in d.collect():
        assert x == f"{'+' if b >= a else '-'}{abs(b - a):.2f} ({abs(b - a) / a * 100:.1f}%)"


def test_payload_keys_spelt_with_escapes(spark):
    bodies = ['{"disc\\u006funtPercent": 5}', '{"store": {"discount": "7%"}}', '{"x": "discount"}', "{", None]
    d = spark.createDataFrame([(b,) for b in bodies], "body string").select(A.first_discount(F.col("body")).alias("x"))
    assert [r.x for r in d.collect()] == ["5", "7%", None, None, None]


def test_many_batches_are_added_once_in_few_jobs(spark, tmp_path):
    """Batches together and alone, again in any order: each once. A thousand batches take the jobs of one."""
    table, schema = str(tmp_path / "table"), "id long"
    d = spark.range(3000).select("id", F.floor(F.col("id") / 3).alias("part"))
    resume.append_many_once(d.filter("part < 0"), table, "part")
    assert resume.read(spark, table, schema).count() == 0
    resume.append_once(d.filter("part = 7").select("id"), table, 7)
    resume.append_many_once(d.unionByName(spark.createDataFrame([(1, None)], "id long, part long")), table, "part")
    resume.append_many_once(d.filter("part % 2 = 0"), table, "part")
    assert not resume.append_once(d.filter("part = 8").select("id"), table, 8)
    assert resume.append_once(spark.range(5000, 5002), table, 2000)
    rows = resume.read(spark, table, schema).collect()
    assert sorted((r.id, r.batch) for r in rows) == [*((i, i // 3) for i in range(3000)), (5000, 2000), (5001, 2000)]
    assert {r.batch: r.rows for r in resume.progress(spark, table).collect()} == {**dict.fromkeys(range(1000), 3), 2000: 2}


def test_blocks_of_rows_are_bounded_by_letters(spark, monkeypatch):
    """Few rows of long texts are as many blocks as their letters ask for, and find what they hold."""
    seen, real = [], C.meeting_blocks
    monkeypatch.setattr(C, "meeting_blocks", lambda left, key, blocks, *rest: seen.append(blocks) or real(left, key, blocks, *rest))
    monkeypatch.setattr(C, "TEXT_LETTERS", 10_000, raising=False)
    texts = spark.range(40).select(F.col("id").alias("row_id"), F.concat(F.repeat(F.lit("x"), 2000), F.when(F.col("id") % 2 == 0, "blue").otherwise("no")).alias("text"))
    found = C.first_contained(texts, spark.createDataFrame([("blue",)], "name string")).collect()
    assert sorted((r.row_id, r.name) for r in found) == [(i, "blue") for i in range(0, 40, 2)]
    assert seen == [9]
