from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, words
from weftline.llm import mixing


def water(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    """Targets by pouring the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    held = {}
    while True:
        left = share * sum(sizes.values()) - sum(held.values())
        free = [s for s in names if s not in held]
        part = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if part[s] > cap[s]]
        if not over:
            return {**held, **part}
        held |= {s: cap[s] for s in over}


def rows_of(spec):
    rows, i = [], 0
    for source, sizes in spec.items():
        for n in sizes:
            rows.append((i, " ".join(["w"] * n), "en", source))
            i += 1
    return rows


def test_targets_and_draws(spark):
    spec = {"a": [10] * 300, "b": [5, 50, 20] * 40, "c": [1] * 2000, None: [7] * 100, "d": [3]}
    rows = rows_of(spec)
    got = mixing.plan(documents(spark, rows).repartition(7)).collect()
    want = water({s: sum(x) for s, x in spec.items()})
    for s, sizes in spec.items():
        own = [r for r in got if r.source == s]
        assert len(own) == len(sizes) and {r.source_size for r in own} == {sum(sizes)}
        assert abs(own[0].target - want[s]) < 1e-6
        taken = sum(r.taken for r in own)
        assert abs(taken - want[s]) <= max(sizes) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in own)
    again = mixing.plan(documents(spark, rows).coalesce(1)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_inclusion_is_about_p(spark):
    """Over many seeds a document of a source whose target is a third of it is drawn about a third of the times."""
    docs = documents(spark, rows_of({"a": [4] * 30, "b": [400] * 60})).cache()
    drawn = [sum(r.taken > 0 for r in mixing.plan(docs, seed=f"s{k}", share=0.5).filter("source = 'b'").collect()) for k in range(6)]
    p = mixing.plan(docs, share=0.5).filter("source = 'b'").first()
    assert all(abs(n - p.target / 400) <= 1 for n in drawn)


def test_mix_repeats_rows(spark):
    docs = documents(spark, rows_of({"a": [10] * 40, "b": [2] * 10})).withColumn("copies", F.lit("mine"))
    out = mixing.mix(docs)
    plan = mixing.plan(docs).agg(F.sum("copies")).first()[0]
    assert out.columns == docs.columns and out.count() == plan


def test_mix_takes_what_the_plan_takes(spark, monkeypatch):
    """Row by row, with null ids and sources, empty texts and ties; by a sent table of sources and by a join."""
    from collections import Counter

    r = __import__("random").Random(4)
    rows = [(r.choice([i, i, i, i // 2, None]), " ".join(["w"] * r.choice([0, 1, 3, 9, 40])), "en", r.choice(["a", "b", "c", None])) for i in range(400)]
    docs = documents(spark, rows)
    size = lambda t: len(words(t))
    plan = {(p.doc_id, p.source, p.size): p.copies for p in mixing.plan(docs).orderBy("copies").collect()}  # of rows alike the one taken most
    want = Counter()
    for i, t, _, s in rows:
        want[i, s, size(t)] += plan[i, s, size(t)]
    for few in (50_000, 0):
        monkeypatch.setattr(mixing, "FEW_SOURCES", few)
        assert Counter((x.doc_id, x.source, size(x.text)) for x in mixing.mix(docs).collect()) == +want


def test_odd_cases(spark):
    got = mixing.plan(documents(spark, [(*r, "en", "s") for r in odd_rows()])).collect()
    assert len(got) == 10 and all(r.taken <= 2 * r.size for r in got)
    assert {r.size for r in got if r.doc_id in (1, 2, 3)} == {0} and sum(r.size for r in got) == sum(len(words(t)) for _, t in odd_rows())
    assert mixing.plan(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.plan(documents(spark, [(1, None, "en", None)])).collect()] == [0]
