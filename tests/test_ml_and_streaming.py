"""M1, M3–M7 (FIXTURES.md §6) and ST1–ST3 against their batch twins."""

import math

import pytest
from pyspark.sql import functions as F

from codescope.operators import clustering as CL
from codescope.operators.fingerprint import fingerprint


def _vecs(spark, vs):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "solution_id long, vector array<double>")


def test_kmeans_two_groups(spark):
    out = {r["solution_id"]: r["cluster"] for r in
           CL.kmeans_labels(_vecs(spark, [(0, 0), (.1, .1), (10, 10), (10.1, 10.1)]), k=2, restarts=3).collect()}
    assert out[0] == out[1] == 0 and out[2] == out[3] == 1


def test_kmeans_small_inputs(spark):
    two = CL.kmeans_labels(_vecs(spark, [(0, 0), (5, 5)]), k=5, restarts=2).collect()
    assert len(two) == 2
    one = CL.kmeans_labels(_vecs(spark, [(1, 1)]), k=3).collect()
    assert [r["cluster"] for r in one] == [0]


def test_pca_values_and_edge_cases(spark):
    out = {r["solution_id"]: (r["x"], r["y"]) for r in CL.pca_2d(_vecs(spark, [(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 0, 0)])).collect()}
    expected = [(3.0798533601, .9431348155), (2.0733269727, .2762521746), (7.2265073056, .3906304663),
                (6.2199809183, .8287565238)]
    for i, (ax, ay) in enumerate(expected):
        assert abs(out[i][0]) == pytest.approx(ax, abs=1e-6) and abs(out[i][1]) == pytest.approx(ay, abs=1e-6)
    again = {r["solution_id"]: (r["x"], r["y"]) for r in CL.pca_2d(_vecs(spark, [(1, 2, 3), (4, 5, 6), (7, 8, 9), (1, 0, 0)])).collect()}
    assert again == out
    assert [(r["x"], r["y"]) for r in CL.pca_2d(_vecs(spark, [(1, 2, 3)])).collect()] == [(0.0, 0.0)]


def test_projection_dispatch(spark):
    two = CL.project_2d(_vecs(spark, [(1, 2), (3, 4)])).orderBy("solution_id").collect()
    assert [(r["x"], r["y"]) for r in two] == [(0.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        CL.project_2d(_vecs(spark, [(1, 2)]), method="tsne")


def test_cluster_map_empty(spark):
    sol = spark.createDataFrame([(1, "m", 0)], "solution_id long, model string, prompt_id long")
    none = spark.createDataFrame([], "solution_id long, vector array<double>")
    assert CL.cluster_map(sol, none).count() == 0


def test_embed_texts(spark):
    df = spark.createDataFrame([(1, "def add(a, b): return a + b"), (2, "")], "id long, t string")
    out = {r["id"]: r["vector"] for r in CL.embed_texts(df, "id", "t").collect()}
    assert len(out[1]) == 384 and sum(v * v for v in out[1]) == pytest.approx(1.0)
    assert sum(abs(v) for v in out[2]) == 0.0


def test_fingerprint_cases(spark):
    one = spark.createDataFrame([(1, 1.0, 1.0, "a")], "solution_id long, f1 double, f2 double, m string")
    assert fingerprint(one, ["f1", "f2"], "m").first()["sufficient_data"] is False
    sep = spark.createDataFrame([(i, float(i < 3) * 10 + i, float(i < 3), "a" if i < 3 else "b") for i in range(6)],
                                "solution_id long, f1 double, f2 double, m string")
    r = fingerprint(sep, ["f1", "f2"], "m", num_trees=10).first()
    assert r["sufficient_data"] and r["cv_accuracy"] > r["baseline_accuracy"] == 0.5


def test_st1_equals_batch(spark):
    from codescope.plans import catalog
    from tests.conftest import SF001
    stream = catalog.QUERIES["st1_analyse_on_arrival"](spark, SF001)
    batch = catalog.QUERIES["x4_complexity_row"](spark, SF001)
    stream = stream.select(*batch.columns)
    assert stream.count() == batch.count()
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0


def _files(spark, path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_st1_late_and_repeated_solutions_over_four_batches(spark, tmp_path):
    from codescope.streaming import analysis as ST
    days = ["2024-03-01", "2020-01-01", "2023-05-05", "2019-12-31"]
    parts = [[(5 * k + i, f"def f{k}_{i}():\n    return {i}\n", day) for i in range(5)] for k, day in enumerate(days)]
    parts[2].append((0, "def f0_0():\n    return 0\n", days[2]))      # arrived before
    parts[3] += [(19, "def f3_4():\n    return 4\n", days[3])] * 2     # repeated within its batch
    stream = _files(spark, str(tmp_path / "in"), parts, "solution_id long, code string, created_at string")
    out = ST.stream_folder(spark, "st1-test")
    ST.analyse_on_arrival(stream, out)
    got = spark.read.parquet(f"{out}/data").collect()
    assert sorted(r["solution_id"] for r in got) == list(range(20))
    assert len({r["batch"] for r in got}) == 4 and all(r["style_score"] is not None for r in got)


def test_st1_remembers_ids_for_as_long_as_asked(spark, tmp_path):
    from codescope.streaming import analysis as ST
    code = "def f():\n    return 1\n"
    parts = [[(1, code, "2024-01-01"), (2, code, "2024-01-01")], [(1, code, "2024-01-05"), (3, code, "2024-06-01")],
             [(4, code, "2024-06-02")], [(3, code, "2024-06-03"), (1, code, "2024-06-03")]]
    stream = _files(spark, str(tmp_path / "in"), parts, "solution_id long, code string, created_at string")
    out = ST.stream_folder(spark, "st1-keep")
    ST.analyse_on_arrival(stream, out, ts_col="created_at", keep="30 days")
    ids = sorted(r["solution_id"] for r in spark.read.parquet(f"{out}/data").collect())
    assert ids == [1, 1, 2, 3, 4]  # 1 came again after its time; 3 did not


def test_st1_batches_do_not_read_earlier_output(spark, tmp_path):
    """The rows a batch reads are its own: its input, and the state of its ids."""
    from codescope.streaming import analysis as ST
    parts = [[(10 * k + i, f"def f{i}():\n    return {k}\n") for i in range(10)] for k in range(4)]
    stream = _files(spark, str(tmp_path / "in"), parts, "solution_id long, code string")
    out = ST.stream_folder(spark, "st1-cost")
    q = ST.analyse_on_arrival(stream, out)
    runs = [p for p in q.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in runs] == [10] * 4
    assert [p["stateOperators"][0]["numRowsTotal"] for p in runs] == [10, 20, 30, 40]
    assert "RocksDB" in str(runs[-1]["stateOperators"][0]["customMetrics"]) or spark.conf.get(
        "spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")


def test_st2_executions_may_arrive_before_and_after_their_solutions(spark, tmp_path):
    from codescope.streaming import analysis as ST
    sols = _files(spark, str(tmp_path / "s"), [[(1, "a")], [(2, "a"), (3, "b")], [(4, "b")]], "solution_id long, model string")
    exe = _files(spark, str(tmp_path / "e"), [[(4, "b", 1.0, None)], [(1, "a", 0.5, 2.0)], [(2, "a", 1.0, 4.0)]],
                 "solution_id long, model string, pass_rate double, runtime_seconds double")
    out = ST.stream_folder(spark, "st2-test")
    ST.live_leaderboard_state(sols, exe, out)
    got = {r["model"]: r for r in ST.read_leaderboard(spark, out).collect()}
    assert (got["a"]["n_solutions"], got["a"]["correctness"], got["a"]["avg_runtime_s"]) == (2, 0.75, 3.0)
    assert (got["b"]["n_solutions"], got["b"]["correctness"], got["b"]["avg_runtime_s"]) == (2, 1.0, None)
    half = 12.706204736174746 * math.sqrt(0.125) / math.sqrt(2)
    assert got["a"]["correctness_ci_high"] == pytest.approx(0.75 + half)


def test_st3_keeps_the_latest_count_and_no_closed_window_in_memory(spark, tmp_path):
    from codescope.streaming import analysis as ST
    t = "2024-01-0{} 00:00:{:02d}"
    parts = [[(1, t.format(1, i)) for i in range(4)], [(1, t.format(1, 10 + i)) for i in range(3)],
             [(1, t.format(5, i)) for i in range(2)], [(2, t.format(8, 0))]]
    stream = _files(spark, str(tmp_path / "e"), parts, "user_id long, ts string")
    out = ST.stream_folder(spark, "st3-test")
    q = ST.run_rate_breaches(ST.rate_breaches(stream, ["user_id"], "ts", limit=2), out)
    got = [(r["user_id"], r["n"]) for r in ST.read_breaches(spark, out, ["user_id"]).collect()]
    assert got == [(1, 7)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_st2_equals_batch_leaderboard(spark):
    from codescope.plans import catalog
    from tests.conftest import SF001
    live = {r["model"]: r for r in catalog.QUERIES["st2_live_leaderboard"](spark, SF001).collect()}
    batch = {r["model"]: r for r in catalog.QUERIES["a2_leaderboard"](spark, SF001).collect()}
    assert set(live) == set(batch)
    for m, b in batch.items():
        for c in ("correctness", "correctness_ci_low", "correctness_ci_high", "avg_runtime_s", "n_solutions"):
            assert live[m][c] == pytest.approx(b[c], abs=1e-6)


def test_st3_rate_breaches_equal_batch(spark):
    from codescope.plans import catalog
    from codescope.sources.tables import read_table
    from tests.conftest import SF001
    got = {(r["user_id"], r["window_start"]) : r["n"] for r in catalog.QUERIES["st3_rate_breaches"](spark, SF001).collect()}
    ev = read_table(spark, SF001, "events")
    want = {(r["user_id"], r["d"]): r["n"] for r in
            ev.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
              .where("n > 5").collect()}
    assert got == want


def test_dbscan_fixture(spark):
    from codescope.operators.dbscan import dbscan
    df = _vecs(spark, [(1, .05), (1.05, 0), (.95, .02), (0, 1)])
    got = {r["solution_id"]: r["cluster"] for r in dbscan(df, eps=0.05, min_samples=2).collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] == -1
    assert [r["cluster"] for r in dbscan(_vecs(spark, [(1, 0)]), eps=0.5, min_samples=2).collect()] == [-1]


def test_dbscan_matches_bruteforce(spark):
    import random
    from codescope.operators.dbscan import dbscan
    rnd = random.Random(3)
    pts = [[rnd.gauss(c, 0.3) for c in centre] for centre in ([1, 0, 0], [0, 1, 0], [0, 0, 1]) for _ in range(12)]
    pts += [[rnd.uniform(-1, 1) for _ in range(3)] for _ in range(6)]
    got = {r["solution_id"]: r["cluster"] for r in dbscan(_vecs(spark, pts), eps=0.08, min_samples=3).collect()}

    import math
    unit = [[x / math.sqrt(sum(y * y for y in p)) for x in p] for p in pts]
    n = len(pts)
    nb = [[j for j in range(n) if 1 - sum(a * b for a, b in zip(unit[i], unit[j])) <= 0.08] for i in range(n)]
    core = [len(nb[i]) >= 3 for i in range(n)]
    label, c = [-1] * n, 0
    for i in range(n):                      # sklearn-style expansion in index order
        if not core[i] or label[i] != -1:
            continue
        stack, label[i] = [i], c
        while stack:
            p = stack.pop()
            for q in nb[p]:
                if label[q] == -1:
                    label[q] = c
                    if core[q]:
                        stack.append(q)
        c += 1
    assert [got[i] for i in range(n)] == label


def test_dbscan_chain_and_spread_points(spark):
    from codescope.operators import components as CC
    from codescope.operators.dbscan import dbscan
    chain = [(math.cos(i * 0.02), math.sin(i * 0.02)) for i in range(120)] + [(-1.0, 0.0)]
    rounds = []
    keep = CC.materialise
    CC.materialise = lambda df, label: rounds.append(label) or keep(df, label)
    try:
        got = [r["cluster"] for r in dbscan(_vecs(spark, chain), eps=0.0003, min_samples=2).orderBy("solution_id").collect()]
    finally:
        CC.materialise = keep
    assert got == [0] * 120 + [-1]
    assert len(rounds) <= 14          # a chain of 120 links


def test_dbscan_blocks_return_no_pairs(spark):
    """Clusters over several blocks, with border rows, copies and a repeated id, against a plain search; all rows alike link."""
    import numpy as np

    from codescope.operators import dbscan as DB
    rng = np.random.default_rng(5)
    pts = np.round(rng.normal(size=(150, 3)), 2)
    pts[100:140] = pts[0]
    sent = []
    keep, size, met = DB.materialise, DB.BLOCK, DB._met
    DB.BLOCK = 40
    DB._met = lambda rows, eps, fn, schema: sent.append(met(rows, eps, fn, schema)) or sent[-1]
    try:
        got = {r["solution_id"]: r["cluster"] for r in DB.dbscan(_vecs(spark, pts.tolist()), eps=0.01, min_samples=4).collect()}
        assert max(d.count() for d in sent) <= 150 * 5  # rows in each task they meet in, not the 780 pairs of copies and more
    finally:
        DB.materialise, DB.BLOCK, DB._met = keep, size, met
    unit = pts / np.sqrt((pts ** 2).sum(1))[:, None]
    near = 1 - unit @ unit.T <= 0.01
    core = near.sum(1) >= 4
    label, c = [-1] * 150, 0
    for i in range(150):
        if core[i] and label[i] == -1:
            todo, label[i] = [i], c
            while todo:
                p = todo.pop()
                for q in np.flatnonzero(near[p]):
                    if label[q] == -1:
                        label[q] = c
                        if core[q]:
                            todo.append(q)
            c += 1
    assert [got[i] for i in range(150)] == label and -1 in label and c > 1
