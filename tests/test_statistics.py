"""A1, A5, A6, A7, W1, W2, X9, X10 — golden values from FIXTURES.md §5."""

import math

import pytest
from pyspark.sql import functions as F

from codescope.functions.tdist import t_ppf, t_two_sided_p
from codescope.operators import describe as D
from codescope.operators.fingerprint import stratified_folds

T975 = {1: 12.706204736174746, 2: 4.302652729698313, 3: 3.1824463048574763, 4: 2.7764451050184613,
        9: 2.262157162798239, 24: 2.063898561628026, 99: 1.9842169514381818}


@pytest.mark.parametrize("df,expected", sorted(T975.items()))
def test_t_quantile_golden(df, expected):
    assert t_ppf(0.975, df) == pytest.approx(expected, abs=1e-9)


def test_t_quantile_symmetry_and_p_inverse():
    for df in (1, 2, 5, 30, 500):
        t = t_ppf(0.975, df)
        assert t_ppf(0.025, df) == pytest.approx(-t)
        assert t_two_sided_p(t, df) == pytest.approx(0.05, abs=1e-12)


def _vals(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "v double")


def test_describe_one_to_five(spark):
    r = D.describe(_vals(spark, [1, 2, 3, 4, 5]), "v").first()
    assert (r["mean"], r["median"], r["n"]) == (3.0, 3.0, 5)
    assert r["stdev"] == pytest.approx(1.5811388300841898)
    assert r["ci_95_high"] - 3.0 == pytest.approx(1.9632431613507502, abs=1e-9)
    assert 3.0 - r["ci_95_low"] == pytest.approx(1.9632431613507502, abs=1e-9)


def test_describe_empty_nulls_single(spark):
    empty = D.describe(_vals(spark, [None]).where("v is not null"), "v").first()
    assert empty["n"] == 0 and empty["mean"] is None and empty["stdev"] is None and empty["ci_95_low"] is None
    r = D.describe(_vals(spark, [1, None, 3, None, 5]), "v").first()
    assert (r["mean"], r["n"]) == (3.0, 3)
    one = D.describe(_vals(spark, [7]), "v").first()
    assert (one["stdev"], one["ci_95_low"], one["ci_95_high"], one["median"]) == (0.0, 7.0, 7.0, 7.0)


def test_describe_grouped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("a", 4.0)], "g string, v double")
    out = {r["g"]: r for r in D.describe(df, "v", "g").collect()}
    assert out["a"]["median"] == 2.0 and out["b"]["n"] == 1


def test_medians_by_selection(spark):
    import random
    import statistics
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, float(rnd.randrange(40)), rnd.random()]), float(i)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    got = {r["g"]: r for r in D.medians(df, {"v": F.col("v"), "w": F.col("w")}, "g").collect()}
    for g in ("a", "b", None):
        assert got[g]["v"] == statistics.median([r[1] for r in rows if r[0] == g and r[1] is not None])
        assert got[g]["w"] == statistics.median([r[2] for r in rows if r[0] == g])
    assert D.describe(df.where("g = 'a'"), "w").first()["median"] == got["a"]["w"]
    plan = D.describe(df, "v", "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def _xy(spark, pairs):
    fl = lambda v: None if v is None else float(v)
    return spark.createDataFrame([(fl(a), fl(b)) for a, b in pairs], "x double, y double")


def test_correlation_linear(spark):
    r = D.correlation(_xy(spark, [(x, 2 * x) for x in range(1, 6)]), "x", "y").first()
    assert r["pearson_r"] > 0.99 and r["spearman_r"] > 0.99 and r["n"] == 5
    assert r["pearson_p"] < 1e-10


def test_correlation_power(spark):
    r = D.correlation(_xy(spark, [(x, x ** 5) for x in range(1, 6)]), "x", "y").first()
    assert r["spearman_r"] > 0.9999 and r["pearson_r"] < r["spearman_r"]
    assert r["pearson_r"] == pytest.approx(0.8679439350990683, abs=1e-12)
    assert r["pearson_p"] == pytest.approx(0.05645158132340522, abs=1e-10)


def test_correlation_too_few_pairs_and_constant(spark):
    r = D.correlation(_xy(spark, [(1.0, 2.0), (2.0, 4.0), (None, 1.0)]), "x", "y").first()
    assert r["n"] == 2 and r["pearson_r"] is None and r["spearman_p"] is None
    c = D.pearson(_xy(spark, [(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)]), "x", "y").first()
    assert c["pearson_r"] is None and c["n"] == 3   # constant column: NULL, not an error


def test_average_rank_ties_matches_bruteforce(spark):
    vals = [3.0, 1.0, 3.0, 2.0, 3.0, 5.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v double")
    got = {r["i"]: r["rank"] for r in D.average_rank(df, "v", partitions=3).collect()}
    for i, v in enumerate(vals):
        less = sum(1 for w in vals if w < v)
        eq = sum(1 for w in vals if w == v)
        assert got[i] == less + (eq + 1) / 2


def _brute_rank(rows):
    out = {}
    for i, g, v in rows:
        if v is not None:
            same = [w for _, h, w in rows if h == g and w is not None]
            out[i] = sum(w < v for w in same) + (sum(w == v for w in same) + 1) / 2
    return out


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_average_rank_without_exchange_reuse_null_group_and_hot_value(spark, reuse):
    import random
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", None]), 7.0 if i % 3 == 0 else rnd.choice([None, rnd.random() * 20])) for i in range(900)]
    df = spark.createDataFrame(rows, "i int, g string, v double")
    old = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = {r["i"]: r["rank"] for r in D.average_rank(df, "v", "g", partitions=16).collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)
    want = _brute_rank(rows)
    assert got == {i: want.get(i) for i, _, _ in rows}


def test_correlation_of_a_null_group(spark):
    rows = [(None, float(x), float(x * x)) for x in range(6)] + [("a", float(x), float(-x)) for x in range(5)]
    got = {r["g"]: r for r in D.correlation(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", "g").collect()}
    assert got[None]["spearman_r"] == pytest.approx(1.0) and got["a"]["spearman_r"] == pytest.approx(-1.0)
    assert got[None]["n"] == 6 and got[None]["pearson_r"] > 0.9


def test_class_balance(spark):
    one = spark.createDataFrame([("a",)], "label string")
    r = D.class_balance(one, "label").first()
    assert r["sufficient_data"] is False and r["n_samples"] == 1
    three = spark.createDataFrame([("a",), ("a",), ("a",)], "label string")
    assert D.class_balance(three, "label").first()["sufficient_data"] is False
    six = spark.createDataFrame([("a",)] * 3 + [("b",)] * 3, "label string")
    r = D.class_balance(six, "label").first()
    assert (r["n_folds"], r["baseline_accuracy"], r["sufficient_data"]) == (3, 0.5, True)


def test_stratified_folds_balanced(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(60)], "id int, label string")
    out = stratified_folds(df, "id", "label", folds=5)
    counts = {(r["label"], r["fold"]): r["count"] for r in out.groupBy("label", "fold").count().collect()}
    assert sorted(set(f for _, f in counts)) == [0, 1, 2, 3, 4]
    assert all(v == 8 for (lab, _), v in counts.items() if lab == "a")
    assert all(v == 4 for (lab, _), v in counts.items() if lab == "b")


def test_t_udf_on_aggregated_rows(spark):
    from codescope.functions.tdist import t_quantile, t_two_sided_pvalue
    df = spark.createDataFrame([(1,), (9,), (99,)], "df int")
    got = {r["df"]: (r["q"], r["p"]) for r in df.select(
        "df", t_quantile(0.975, F.col("df")).alias("q"),
        t_two_sided_pvalue(F.lit(2.0), F.col("df")).alias("p")).collect()}
    for d in (1, 9, 99):
        assert got[d][0] == pytest.approx(T975[d], abs=1e-9)
        assert 0 < got[d][1] < 1 and not math.isnan(got[d][1])
