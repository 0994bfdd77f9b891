"""Rows without id and rows that repeat an id: every query runs and gives its defined result."""

import pytest

from codescope.llm import queries as Q
from tests.llm.conftest import SCHEMA, prose


@pytest.fixture(scope="module")
def ids_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("ids"))
    rows = [(None, prose(1, 60), "en", "src1", 0), (None, prose(2, 60), None, None, None), (5, prose(1, 60), "en", "src1", 0),
            (5, prose(1, 60), "en", "src1", 0), (6, prose(3, 60), "de", "src2", 0), (6, prose(4, 60), "de", "src2", 0),
            (7, None, None, None, None)] + [(20 + i, prose(40 + i, 50), ["en", "de"][i % 2], "src3", 0) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(20 + i, 1, i % 3 == 0) for i in range(12)], "doc_id bigint, quality int, toxic boolean").selectExpr(
        "doc_id", "quality", "cast(toxic as int) AS toxic").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None, None, None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{d}/conversations.parquet")
    return d


#: Queries whose rows are documents by id: a repeated id is one document there, elsewhere each row is its own.
BY_ID = {"op7_ngram_jaccard_join"}


#: Queries of other tables, or of some rows only.
OTHERS = {"op1_chat_formatting", "op3_mixing", "op11_embedding_near_dedup", "op13_embedding_whitening"}


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - OTHERS))
def test_null_and_repeated_ids(spark, ids_dir, name):
    got = [r.doc_id for r in Q.QUERIES[name](spark, ids_dir).collect()]
    want = [None, 5, 6, 7] if name in BY_ID else [None, None, 5, 5, 6, 6, 7]
    assert sorted(got, key=lambda x: (x is not None, x or 0)) == want + list(range(20, 32))


def test_mixing_selects_rows_with_odd_ids_and_chat_formats_a_null_row(spark, ids_dir):
    rows = Q.QUERIES["op3_mixing"](spark, ids_dir).collect()
    assert rows and all(r.take_tokens <= r.n_tokens for r in rows) and 7 not in {r.doc_id for r in rows}
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in Q.QUERIES["op1_chat_formatting"](spark, ids_dir).collect()}
    assert got == {None: (1, 0), -7: (2, 26)}


def test_op3_numbers_of_any_length_in_source_names(spark):
    from codescope.llm import mixing
    names = {"src5": "books", "a12345678901234567890123": "forum", "b99999999999999999999999999996": "web", "plain": "web"}
    df = spark.createDataFrame([(i, "one two", "en", s, 0) for i, s in enumerate(names)], SCHEMA)
    assert {r.source: r.domain for r in mixing.with_tokens(df).collect()} == names
