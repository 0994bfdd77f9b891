"""J3 above a threshold against brute force over all pairs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from codescope.operators import threshold_pairs as TP

ENTRIES = "prompt_id int, solution_id int, entries array<struct<dim: string, w: double>>"


def corpus_rows(seed: int, n: int, signed: bool = False):
    """Rows of five prompts, one of which holds a third; copies, scaled copies, near copies and rows without entries."""
    r = random.Random(seed)
    bags = [{f"d{int(r.expovariate(0.2))}": float(r.randint(1, 9)) for _ in range(r.randint(1, 9))} for _ in range(n // 3)]
    rows = []
    for i in range(n):
        bag = dict(r.choice(bags)) if r.random() < 0.95 else {}
        if bag and r.random() < 0.3:
            bag[r.choice(list(bag))] += 1
        if r.random() < 0.1:
            bag = {d: 2 * w for d, w in bag.items()}
        if signed:
            bag = {d: w * r.choice([1, -1, 1]) for d, w in bag.items()}
        rows.append((0 if i % 3 == 0 else 1 + i % 4, i, bag))
    return rows


def cosine(a, b):
    norm = lambda x: math.sqrt(sum(w * w for w in x.values()))
    return min(1.0, sum(w * b.get(d, 0.0) for d, w in a.items()) / (norm(a) * norm(b))) if a and b else 0.0


def frame(spark, rows):
    return spark.createDataFrame([(p, i, [(d, w) for d, w in bag.items()]) for p, i, bag in rows], ENTRIES).repartition(4)


@pytest.mark.parametrize("t,signed", [(0.3137, False), (0.8137, False), (0.9537, False), (0.7137, True), (1.0, False)])
def test_every_pair_above_the_threshold(spark, t, signed):
    rows = corpus_rows(int(t * 100), 150, signed)
    df = frame(spark, rows)
    pairs = TP.cosine_pairs(TP.histogram_classes(df), t)
    links = {r.solution_id: (r.class_id, r.n_links) for r in TP.link_counts(df, pairs).collect()}
    want = {i: 0 for _, i, _ in rows}
    total = 0
    for (p, i, a), (q, j, b) in itertools.combinations(rows, 2):
        near = p == q and (a == b != {} or cosine(a, b) >= t)
        if near:
            want[i] += 1
            want[j] += 1
            total += 1
    if t < 1:  # at 1, scaled copies are equal up to rounding
        assert {i: k for i, (_, k) in links.items()} == want
        assert pairs.agg(F.sum("n_links")).first()[0] == total
    first = {}
    for p, i, bag in rows:
        first.setdefault((p, tuple(sorted(bag.items()))), i)
    assert all(links[i][0] == (first[p, tuple(sorted(bag.items()))] if bag else None) for p, i, bag in rows)


def test_the_index_leaves_few_candidates(spark):
    """Classes that share only frequent dimensions do not meet, however many a prompt has."""
    rows = [(1, i, {"common": 1.0, f"own{i}": 2.0, f"more{i}": 2.0}) for i in range(400)]
    classes = TP.with_norm(TP.histogram_classes(frame(spark, rows)))
    assert TP.candidate_pairs(classes, 0.8, "prompt_id").count() == 0


def test_hot_class_is_counted_not_expanded(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("prompt_id"), F.col("id").cast("int").alias("solution_id"), F.array(F.struct(
        F.lit("x").alias("dim"), F.lit(1.0).alias("w"))).alias("entries"))
    (r,) = TP.cosine_pairs(TP.histogram_classes(rows), 0.9).collect()
    assert (r.class_a, r.class_b, r.n_links) == (0, 0, 300_000 * 299_999 // 2)


def test_empty_and_bad_threshold(spark):
    empty = TP.histogram_classes(spark.createDataFrame([], ENTRIES))
    assert TP.cosine_pairs(empty, 0.5).count() == 0
    with pytest.raises(ValueError):
        TP.cosine_pairs(empty, 0.0)


def test_dense_vectors_and_words(spark):
    sol = spark.createDataFrame([(1, 1, "a b a"), (1, 2, "a  a b"), (1, 3, None), (2, 4, "a b a")], "prompt_id int, solution_id int, code string")
    from codescope.operators.similarity import token_counts
    rows = TP.word_entries(sol, token_counts(sol))
    got = TP.cosine_pairs(TP.histogram_classes(rows), 0.9).collect()
    assert [(r.class_a, r.class_b, r.n_links) for r in got] == [(1, 1, 1)]
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, None])], "solution_id int, vector array<double>")
    (r,) = TP.cosine_pairs(TP.histogram_classes(TP.vector_entries(sol, vec)), 0.9).collect()
    assert (r.class_a, r.class_b) == (1, 2) and abs(r.similarity - 1 / math.sqrt(1.01)) < 1e-12


def test_small_prompts_are_compared_whole_and_agree_with_the_index(spark, monkeypatch):
    classes = TP.histogram_classes(frame(spark, corpus_rows(7, 150, True))).persist()
    by = {small: sorted((r.prompt_id, r.class_a, r.class_b, r.n_links, round(r.similarity, 9)) for r in TP.cosine_pairs(classes, 0.6137, small=small).collect())
          for small in (0, 200, TP.SMALL)}
    assert len(by[0]) > 40 and by[0] == by[200] == by[TP.SMALL]
    monkeypatch.setattr(TP, "candidate_pairs", None)  # entries do not become rows
    assert TP.cosine_pairs(classes, 0.6137).count() == len(by[0])


def test_groups_are_cut_whole_between_batches(spark, monkeypatch):
    monkeypatch.setattr(TP, "SMALL", 40)
    classes = TP.with_norm(TP.histogram_classes(frame(spark, corpus_rows(8, 200))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = sorted(tuple(r) for r in TP.small_pairs(classes, 0.5137).select("prompt_id", "class_a", "class_b", "n_a", "n_b").collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == sorted(tuple(r) for r in TP.indexed_pairs(classes, 0.5137).select("prompt_id", "class_a", "class_b", "n_a", "n_b").collect())


def test_infinite_and_missing_values_go_on_as_before(spark):
    rows = spark.createDataFrame([(1, 1, [("a", float("inf")), ("b", 1.0)]), (1, 2, [("b", 1.0)]), (1, 3, [("b", 2.0)]), (None, 4, [("b", 1.0)]),
                                  (None, 5, [("b", 2.0)])], ENTRIES)
    got = sorted((r.class_a, r.class_b) for r in TP.cosine_pairs(TP.histogram_classes(rows), 0.5).collect())
    assert got == [(2, 3)]


def test_words_do_not_become_rows(spark):
    from codescope.operators.similarity import token_counts
    sol = spark.createDataFrame([(1, 1, "a b a  # c\n\tb\x0bc"), (1, 2, "x"), (1, 2, "x y"), (2, 3, None), (2, None, "a"), (2, 4, "\u00e9 \u00a0z \u2003")],
                                "prompt_id int, solution_id int, code string")

    def found(df):
        return sorted((str(r.prompt_id), str(r.solution_id), sorted(map(tuple, r.entries))) for r in df.collect())

    assert found(TP.text_entries(sol)) == found(TP.word_entries(sol, token_counts(sol)))
    once = TP.text_entries(sol.where("solution_id <> 2"))
    assert "Generate" not in once._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["j3_link_counts", "s10_results_document"])
def test_sources_are_parsed_once(spark, name):
    """What several steps read is written before, so the query's own plan has no parse."""
    from codescope.plans import catalog
    assert "parse_error" not in catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
