"""NN-descent, Merkle manifest and whitening against brute force, on odd rows and small parameters."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codescope.llm import merkle, near_vectors, whitening
from tests.llm.conftest import EMBEDDINGS, SF01, odd_documents, odd_embeddings

# --- near-duplicate embeddings ------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.95):
    """(vec_id, links, smallest reachable id) of each row."""
    unit = []
    for _, v, *_ in rows:
        fine = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        w = np.array(v, np.float32).astype(float) if fine else None
        unit.append(w / np.linalg.norm(w) if fine else None)
    n = len(rows)
    near = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= threshold] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        seen |= reach
        ids = [rows[j][0] for j in reach if rows[j][0] is not None]
        for j in reach:
            out[j] = (rows[j][0], len(near[j]), min(ids, default=None), rows[j][0] == min(ids, default=None))
    return sorted(out, key=repr)


def found_links(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def test_op11_equals_brute_force(spark, odd_dir):
    got = found_links(near_vectors.op11_embedding_near_dedup(spark, odd_dir))
    assert got == brute_links(odd_embeddings())
    assert max(r[1] for r in got) >= 60  # more links than a list has room for


def test_op11_small_blocks_and_lists(spark, monkeypatch):
    """Groups cut into many blocks, and lists that saturate at once."""
    monkeypatch.setattr(near_vectors, "BLOCK", 7)
    monkeypatch.setattr(near_vectors, "STEP", 5)
    monkeypatch.setattr(near_vectors, "LIST", 2)
    monkeypatch.setattr(near_vectors, "LIST_MOST", 4)
    df = spark.createDataFrame(odd_embeddings(), EMBEDDINGS)
    assert found_links(near_vectors.near_vectors(df)[0]) == brute_links(odd_embeddings())


def test_op11_missing_and_repeated_ids(spark):
    rows = [(None, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (4, [1.0, 0.01], 0), (4, [0.0, 1.0], 0), (4, [0.0, 1.0], 0), (None, [0.6, 0.6], 0)]
    got = found_links(near_vectors.near_vectors(spark.createDataFrame(rows, EMBEDDINGS))[0])
    want = [(v, n, c, v == c) for v, n, c in [(None, 2, 4), (None, 2, 4), (4, 2, 4), (4, 1, 4), (4, 1, 4), (None, 0, None)]]
    assert got == sorted(want, key=repr)


def test_op11_search_finds_links_without_help_of_the_tables(spark, monkeypatch):
    """With one short table the descent and the audit's extra tables still reach the wanted recall."""
    monkeypatch.setattr(near_vectors, "TABLES", 1)
    monkeypatch.setattr(near_vectors, "WINDOW", 4)
    r = np.random.default_rng(5)
    base = r.normal(size=(1500, 24))
    base[750:] = base[:750] + r.normal(size=(750, 24)) * 0.2
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    df, (recall,) = near_vectors.near_vectors(spark.createDataFrame(rows, EMBEDDINGS))
    want = {r[0]: r for r in brute_links(rows)}
    got = {r[0]: r for r in found_links(df)}
    linked = [i for i in want if want[i][1]]
    assert len(linked) > 1000 and recall >= 0.9
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.9
    assert all(got[i][1] <= want[i][1] for i in want)  # no link below the threshold


# --- Merkle manifest ----------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves, fanout):
    """The root and each leaf's (left, right) siblings by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            lo = k - k % fanout
            paths[i].append(("".join(level[lo:k]), "".join(level[k + 1:lo + fanout])))
            at[i] = k // fanout
        level = [h(*level[k:k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], paths


@pytest.mark.parametrize("fanout,height,counts", [(3, 1, (1, 2, 3, 4, 9, 10, 28, 83)), (2, 1, (1, 2, 5, 33)), (3, 2, (9, 10, 81, 82, 250)),
                                                  (4, 1, (17, 65))])
def test_manifest_equals_brute_force(spark, fanout, height, counts):
    rows = [(f"t{t}" if t else None, h(str(t), str(i)), i) for t, n in enumerate(counts) for i in range(n)]
    random.Random(3).shuffle(rows)
    got = merkle.manifest(spark.createDataFrame(rows, "tree string, digest string, i int"), ["i"], fanout, height).collect()
    trees = [brute_tree([h(str(t), str(i)) for i in range(n)], fanout) for t, n in enumerate(counts)]
    root, tops = brute_tree([t[0] for t in trees], fanout)
    want = sorted((h(str(t), str(i)), sub, root, paths[i] + tops[t]) for t, (sub, paths) in enumerate(trees) for i in range(counts[t]))
    assert sorted((r.digest, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got) == want


def test_op12_on_odd_documents(spark, odd_dir):
    """Every proof folds to the root; a document is refused exactly if tampering changes it."""
    got = {r.doc_id: r for r in merkle.op12_merkle_manifest(spark, odd_dir).collect()}
    assert len({r.root for r in got.values()}) == 1 and len(got) == len(odd_documents())
    for doc, text, lang, source, n in odd_documents():
        own = [str(doc), source, lang, None if n is None else str(n), text]
        assert got[doc].leaf == h(*["-" if v is None else f"{len(v.encode())}:{v}" for v in own])
        assert got[doc].verified == (zlib.crc32(str(doc).encode()) % 2 != 0 or "\n" not in (text or ""))


def test_op12_repeated_and_missing_ids(spark, tmp_path):
    rows = [(None, "a\nb", "en", None, 1), (5, "x", None, None, 1), (5, "x", None, None, 1), (5, "y\n", None, "s", None), (None, None, None, "s", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(got) == 5 and len({r.root for r in got}) == 1
    assert sorted(r.leaf for r in got if r.doc_id == 5) == sorted([h("1:5", "-", "-", "1:1", "1:x")] * 2 + [h("1:5", "1:s", "-", "-", "2:y\n")])
    tampered = zlib.crc32(b"5") % 2 == 0
    assert [r.verified for r in got if r.doc_id is None] == [True, True]
    assert sum(not r.verified for r in got) == int(tampered)


# --- whitening ----------------------------------------------------------------------------------------------------


def brute_whitening(rows, weight="one"):
    fine = [(i, v) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for d in {len(v) for _, v in fine}:
        own = [(i, v) for i, v in fine if len(v) == d]
        x = np.array([np.floor(np.float32(v).astype(float) * 64).astype(np.int64) + 1_000_000 for _, v in own])
        fit = np.unique(x, axis=0) if weight == "one" else x
        n, s = len(fit), fit.sum(0)
        c = fit - s / n
        e, w = np.linalg.eigh(c.T @ c / n)
        order = np.argsort(-e)[:16]
        z = (x - s / n) @ w[:, order] / np.sqrt(np.where(e[order] > 1e-12 * max(e.max(), 1e-300), e[order], np.nan))
        for (i, _), row, dev in zip(own, z, ((n * x - s) ** 2).sum(1)):
            out[i] = (n, int(dev), row, e[order] / max(np.trace(c.T @ c / n), 1e-300))
    return out


@pytest.mark.parametrize("weight", ["one", "count"])
def test_op13_equals_brute_force(spark, odd_dir, weight):
    df = spark.read.parquet(f"{odd_dir}/embeddings.parquet").select("vec_id", "embedding")
    got = {}
    for r in whitening.whiten(df, weight).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    want = brute_whitening(odd_embeddings(), weight)
    assert set(got) == set(want)
    wide = [i for i in want if len(want[i][2]) == 16]
    signs = np.sign(sum(np.array([got[i][k + 1].whitened for k in range(16)]) * want[i][2] for i in wide))
    for i, (n, dev, z, share) in want.items():
        assert sorted(got[i]) == list(range(1, len(z) + 1))
        for k in range(len(z)):
            r = got[i][k + 1]
            assert (r.n, r.deviation) == (n, dev) and abs(r.explained - share[k]) < 1e-9 and r.identity_error <= 1e-4
            assert (r.whitened is None) == bool(np.isnan(z[k]))
            if len(z) == 16:
                assert abs(r.whitened * signs[k] - z[k]) < 1e-7


def test_op13_on_the_test_table(spark):
    rows = whitening.op13_embedding_whitening(spark, SF01).where("component = 1").collect()
    assert len(rows) == 500 and rows[0].identity_error < 1e-9


def test_op13_flat_and_huge_vectors(spark):
    """One vector has no direction; what does not fit is left out or null, and nothing fails."""
    one = spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(one).collect()
    assert len(got) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, 0.0, 0.0)}
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [3e16, 1.0]), (3, [-3e16, 2.0]), (4, [0.0, 3.0])], "vec_id bigint, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert {r.vec_id for r in got} == {2, 3, 4} and {r.deviation is None for r in got if r.vec_id == 2} == {True}


def test_folding_many_products(spark):
    x = [(i, [float(i % 7), float(i % 11), float(i % 13)]) for i in range(4000)]
    df = spark.createDataFrame(x, "vec_id bigint, embedding array<double>").repartition(40)
    got = whitening.folded(df.select("embedding", F.lit(2).cast("bigint").alias("w")), lambda b: whitening._matrix(b.column(0)), 3)
    m = np.array([v for _, v in x])
    assert np.allclose(got, 2 * m.T @ m)
