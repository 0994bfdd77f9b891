"""Documents without an id, or that share one, go through the pipeline's stages as documents of their own."""

import corpus_pipeline
from codescope.llm import common, jaccard_join, suffix_dedup
from tests.llm.conftest import SCHEMA, prose


def texts(df):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.text) for r in df.collect())


def test_distinct_documents_without_or_with_one_id_all_stay(spark):
    rows = [(None, prose(600 + i, 60), "en", "src1", 0) for i in range(20)] + [
        (5, prose(700 + i, 60), "de", "src2", 0) for i in range(8)] + [(9, prose(800, 60), "en", "src1", 0)]
    near = rows[0][1].split()
    near[3] = "changed"
    extra = [rows[0], (5, " ".join(near), "en", "src1", 0), (11, rows[21][1], "en", "src1", 0)]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows + extra, SCHEMA).repartition(5))
    assert kept.columns == spark.createDataFrame([], SCHEMA).columns
    assert texts(kept) == texts(spark.createDataFrame(rows, SCHEMA))  # copies and near copies go, the rest stays


def test_keys_follow_ids_whatever_the_partitioning(spark):
    df = spark.createDataFrame([(i % 7 or None, prose(i, 9), None, None, 0) for i in range(40)] + [(1, None, None, None, 0)], SCHEMA)
    got = []
    for n in (1, 6):
        keyed, repeated = common.with_keys(df.repartition(n))
        assert repeated and keyed.count() == 41
        got.append(sorted((r[common.KEY], r.doc_id, r.text) for r in keyed.collect()))
    assert got[0] == got[1] and [k for k, _, _ in got[0]] == list(range(41))
    ids = [i or 0 for _, i, _ in got[0]]
    assert ids == sorted(ids)


def test_each_row_of_a_shared_id_keeps_its_own_text(spark):
    passage = prose(900, 40)
    rows = [(i, prose(910 + k, 30) + " " + passage + " " + prose(930 + k, 30), "en", "src1", 0)
            for k, i in enumerate([None, None, None, 4, 4, 8])]
    df = spark.createDataFrame(rows, SCHEMA)
    out = suffix_dedup.without_repeats(df.repartition(3)).collect()
    assert len(out) == 6 and sum(passage in r.text for r in out) == 1
    assert sorted(r.text[:60] for r in out) == sorted(r[1][:60] for r in rows)  # each its own beginning
    assert [r.doc_id for r in out if passage in r.text] == [None]
    assert all(r.n_chars == len(r.text) for r in out if passage not in r.text)


def test_rows_without_id_reach_the_packed_pieces(spark):
    rows = [(None, prose(1000 + i, 50), "en", "src1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = common.materialise(stage(spark, docs, ""), name)
        assert docs.count() == (27 if name == "mixing" else 30)  # nine tenths of the tokens, all texts equally long
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() == 27
