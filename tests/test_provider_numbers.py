import pytest

from weftline.operators import providers as P


@pytest.fixture
def wide(spark):
    """Partitions stay as they are dealt, so that a result of one task shows."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield spark
    spark.conf.unset(key)


def health(spark, n=200):
    rows = [(f"p{i % 7}", f"m{i}", n - i, i % 3 > 0, "json", None, 200, None, i % 4, i % 5, float(i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, "provider string, model string, seq long, ok boolean, mode string, error_type string, http_status int, error_message string, rotation_tier int, quality_rank int, elapsed_s double")


def test_numbers_do_not_come_from_one_task(wide):
    h = health(wide)
    attempts = h.select("provider", "model", (1000 - h.seq).alias("turn"))
    for d, n, name in (
        (P.ranked_health(h), 200, "rotation_rank"),
        (P.by_health(attempts, h, ["provider", "model"], "turn"), 200, "position"),
        (P.healthy_combinations(h, ["provider", "model"]), 133, "position"),
    ):
        assert d.rdd.getNumPartitions() > 1
        assert sorted(r[name] for r in d.collect()) == list(range(1, n + 1))


def test_healthy_come_first_by_their_order(wide):
    h = health(wide)
    attempts = h.select("provider", "model", (1000 - h.seq).alias("turn"))
    ok = {r.model: (not r.ok, r.seq) for r in h.collect()}
    got = [r.model for r in P.by_health(attempts, h, ["provider", "model"], "turn").orderBy("position").collect()]
    assert got == sorted(ok, key=lambda m: ok[m])
    first = [r.model for r in P.healthy_combinations(h, ["provider", "model"]).orderBy("position").collect()]
    assert first == [m for m in got if not ok[m][0]]
