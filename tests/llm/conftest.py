from __future__ import annotations

import random

import duckdb
import pytest

from codescope.llm import queries as Q

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

_rng = random.Random(4)
_vocab = ["".join(_rng.choice("abcdefghiklmnoprstuvw") for _ in range(_rng.randint(2, 8))) for _ in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(_vocab) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls, empty and very long texts, copies, near copies, shared passages, repeated lines and odd characters."""
    passage = prose(99, 60)
    rows = [(0, None, None, None, None), (1, "", "en", "src1", 0), (2, " \t\n ", None, "src2", 4), (3, "one", "en", None, 3),
            (4, prose(1, 5000), "en", "src0", 1), (5, "Été \U0001f600 naïve ẞ Straße 12", "fr", "src3", 1)]
    for i in range(6, 30):
        rows.append((i, prose(i, 40 + i * 7), "en" if i % 3 else "de", f"src{i % 5}", i))
    for i in range(30, 36):  # exact copies
        rows.append((i, rows[10][1], "en", "src0", 1))
    for i in range(36, 46):  # near copies
        words = rows[12][1].split()
        words[i % len(words)] = "changed" + "abcdefghij"[i - 36]
        rows.append((i, " ".join(words), "en", "src0", 1))
    for i in range(46, 52):  # a passage inside other text
        rows.append((i, prose(i, 30) + " " + passage + " " + prose(i + 100, 25), "en", "src4", 1))
    rows.append((52, "same line again\n" * 30 + prose(52, 30), "en", "src0", 1))
    rows.append((53, "### ** && <<|>> " * 20 + prose(53, 30), "en", "src0", 1))
    rows.append((-8, "Released under the MIT License. THE MIT LICENSE; cc by-nc 4.0 " + prose(54, 20), "en", "src1", 1))
    rows.append((1 << 40, "Licensed under the Apache License, Version 2.0. " * 2, "en", "src1", 1))
    return rows


EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def odd_embeddings() -> list[tuple]:
    """Copies, near copies, a chain of links, another width, zero, null, empty and non-finite vectors."""
    r = random.Random(11)
    v = [[r.gauss(0, 1) for _ in range(16)] for _ in range(60)]
    rows = [(i, x, 0) for i, x in enumerate(v)]
    rows += [(100 + i, v[3], 1) for i in range(5)]  # exact copies
    rows += [(200 + i, [x + r.gauss(0, 0.02) for x in v[7]], 1) for i in range(60)]  # a group longer than any list
    chain = v[9]
    for i in range(6):  # neighbours link, the ends do not
        chain = [x + r.gauss(0, 0.25) for x in chain]
        rows.append((300 + i, chain, 2))
    rows += [(400, [0.0] * 16, 0), (401, None, 0), (402, [], 0), (403, [float("nan")] + v[1][1:], 0), (404, [None] + v[1][1:], 0),
             (405, [float("inf")] + v[1][1:], 0), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (-5, v[7], 0)]
    return rows


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """The tables with odd documents, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F
    d = str(tmp_path_factory.mktemp("odd"))
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    clash = {c: F.lit(7) for c in ("sig", "doc", "node", "key", "piece", "length", "label", "n_words", "rest", "block",
                                      "tree", "digest", "at", "seq", "pos", "path", "root", "tampered")}
    df.withColumns(clash).repartition(3, "doc_id").write.parquet(f"{d}/documents.parquet")
    conv = [(1, 0, "user", "a <b> \\l \\b"), (1, 1, "assistant", None), (1, 1, "assistant", "tie"), (1, 1, None, "tie"),
            (None, 0, "assistant", "x</turn>\n"), (2, None, "sys>tem", ""), (2, 5, "assistant", "z" * 50_000)]
    conv += [(9, t, "assistant" if t % 2 else "user", f"turn {t} \\ <") for t in range(700)]
    spark.createDataFrame(conv, "conv_id bigint, turn bigint, role string, text string").withColumns(
        {"msg": F.lit(1), "seq": F.lit(2)}).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(odd_embeddings(), EMBEDDINGS).withColumns(
        {c: F.lit(3) for c in ("node", "v", "x", "w", "copies", "d", "h", "q", "first")}).write.parquet(f"{d}/embeddings.parquet")
    y = [(i, 1, int(i % 4 == 0)) for i in range(6, 30)] + [(6, 1, None), (8, 0, 1), (None, 1, 1)]
    spark.createDataFrame(y, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", SCHEMA), ("conversations", "conv_id bigint, turn bigint, role string, text string"),
                         ("labels", "doc_id bigint, quality int, toxic int"), ("embeddings", EMBEDDINGS)):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def sql_rows(directory: str, name: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{directory}/{t}.parquet/*.parquet')")
    rel = con.sql(Q.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    return tidy(tuple(r[i] for i in at) for r in rel.fetchall())


def tidy(rows) -> list[tuple]:
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
