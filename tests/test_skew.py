"""A third of all rows in one key: outputs stay bounded, plans stay equi-joins."""

from pyspark.sql import functions as F

from codescope.operators import describe as D
from codescope.operators import similarity as SIM
from codescope.operators.codefacts import source_facts
from codescope.plans.corpus import CODE_TEMPLATES
from codescope.sources import store as S

N = 3000


def _skewed(spark):
    rows = []
    for i in range(N):
        prompt = 0 if i < N // 3 else 1 + i % 50       # prompt 0 holds a third of the rows
        model = "hot" if i % 3 else f"m{i % 4}"          # one model holds two thirds
        rows.append((i, prompt, model, CODE_TEMPLATES[i % 8].replace("KEY", str(i))))
    return spark.createDataFrame(rows, "solution_id long, prompt_id long, model string, code string")


def test_pairs_bounded_by_models(spark):
    sol = _skewed(spark)
    models = sol.select("model").distinct().count()
    pairs = SIM.coverage_pairs(sol)
    assert pairs.count() <= N * models
    agg = SIM.model_pair_similarity(sol, source_facts(sol.select("solution_id", "code")))
    hot = agg.where("prompt_id = 0").collect()
    assert len(hot) <= models * (models + 1) // 2
    n_hot = sol.where("prompt_id = 0").count()
    assert sum(r["n_pairs"] for r in hot) == n_hot * (n_hot - 1) // 2      # every pair accounted for
    plan = agg._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rank_and_dedup_with_hot_key(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", float(i % 7)) for i in range(N)],
                               "id long, g string, v double")
    ranked = D.average_rank(df, "v", "g", partitions=8)
    assert ranked.where("rank IS NULL").count() == 0
    top = ranked.where("g = 'hot'").agg(F.max("rank")).first()[0]
    hot_n = df.where("g = 'hot'").count()
    assert top <= hot_n
    dup = spark.createDataFrame([("k", i, float(i)) for i in range(N)], "solution_id string, t long, v double")
    assert S.enforce_unique(dup, None, "solution_id", "replace", "t").first()["v"] == float(N - 1)
