import numpy as np
from pyspark.sql import functions as F

from sunloom.operators import ranks, stats, windows

V = "g string, v double, n int, k int"


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(0, 100, 500), "b": np.repeat([0.0, -1.5, 7.0], 40), "c": np.array([3.25]), None: np.r_[-np.inf, np.inf, 1e-300, -1e-300, 0.0, 1e300], "d": 5 + rng.random(300) * 1e-9}
    rows = [(g, float(v), 1, 2) for g, x in groups.items() for v in x] + [("a", None, 1, 2), ("a", float("nan"), 1, 2), ("none", None, 1, 2)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], V).repartition(5)
    levels = {"low": 0.0, "q1": 0.25, "q": 0.999, "high": 1.0}
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "v", levels).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        assert got[g].n == len(x)
        for name, q in levels.items():
            if q in (0.0, 1.0) or np.isfinite(x).all():
                assert np.isclose(got[g][name], {0.0: x.min(), 1.0: x.max()}.get(q) if q in (0.0, 1.0) else np.quantile(x, q), rtol=1e-12), (g, name)
    unbiased = {r.g: r.q for r in stats.unbiased_quantile(df, ["g"], "v", {"q": 0.975}).collect()}
    assert np.isclose(unbiased["a"], np.quantile(groups["a"], 0.975, method="median_unbiased"))
    assert ranks.quantiles(df.limit(0), ["g"], "v", levels).count() == 0


def test_cells_keep_the_order(spark):
    rng = np.random.default_rng(1)
    x = np.sort(np.r_[rng.normal(size=200), 10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 200)), 0.0, np.inf, -np.inf])
    cells = [r.c for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").select("i", ranks.cell_of(F.col("v")).alias("c")).orderBy("i").collect()]
    assert cells == sorted(cells)


def test_two_states_in_shards_as_in_one(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for system in ("a", "b", None):
        x = y = 0.0
        for i in range(400):
            a, b = rng.choice([0.1, 1.0], 2)
            if (i // 40) % 4 == 1:
                a = b = 1.0
            x, y = min(x, y + 2) + a, min(y, x + 2) + b
            rows.append((system, i // 40, i, float(a), float(b)))
            want[system, i] = y < x and not np.isclose(x, y)
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "s string, day int, i int, a double, b double").repartition(6)
    for shard in (None, "day"):
        got = {(r.s, r.i): r.inside for r in windows.two_state_labels(df, ["s"], "i", "a", "b", 2.0, shard).collect()}
        assert set(got) == set(want) and sum(got[k] != want[k] for k in want) <= 0.02 * len(want), shard
    both = [{(r.s, r.i): r.inside for r in windows.two_state_labels(df.withColumn("b", F.col("b") + 0.013), ["s"], "i", "a", "b", 2.0, k).collect()} for k in (None, "day")]
    assert both[0] == both[1]
    assert windows.two_state_labels(df.limit(0), ["s"], "i", "a", "b", 2.0, "day").count() == 0


def test_best_sensor_of_equal_ones_is_the_first_by_name(spark):
    df = spark.createDataFrame([("s", "b", 0.9, 1.0), ("s", "a", 0.9, 2.0), ("s", "c", None, 0.0), ("t", "z", None, 1.0)], "system string, sensor string, corr double, rmse double")
    assert {(r.system, r.sensor) for r in stats.best_sensor(df, ["system"]).collect()} == {("s", "a"), ("t", "z")}


def test_aggregates_of_the_user(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.2, 2.1, 9.0), (7.0, 2.0, 1.0)], "x double, y double, v double")
    for how in (spread, lambda c: F.max(c) - F.min(c), F.max("v") - F.min("v")):
        assert {(r.bx, r.value, r.n) for r in stats.binned(df, "x", "y", "v", 1.0, 1.0, how).collect()} == {(1.0, 4.0, 2), (7.0, 0.0, 1)}
