"""Similarity of solutions within a prompt.

Two shapes, neither of which expands all solution pairs of a prompt:

* ``model_pair_similarity`` — per (prompt, model_a, model_b) the exact mean
  AST cosine and mean embedding cosine over *all* solution pairs, from sums
  of unit vectors: for models A ≠ B the pair sum is S_A · S_B, for A = B it
  is (|S_A|² − Σ|u_i|²) / 2. Inputs are reduced with partial aggregation per
  (prompt, model[, node_type]); the only self-join is over that reduced
  table, so its size is bounded by #models² per prompt, however many
  solutions a prompt holds (a hot prompt with a third of the data included).

* ``coverage_pairs`` + scorers — pairwise scores (token overlap, AST cosine,
  embedding cosine) between every solution and the first-appearing solution of
  each model of its prompt: at most n × #models rows, and every solution appears. When a prompt
  has one solution per model (the normal run) this is exactly every solution pair.
  Pairs and solutions that were dealt to cells where they were made (``dealt``, ``in_cells``) meet in one shuffle;
  other pairs are dealt by ``pair_cells.cells`` and joined with their scores.

Orientation: solution_a < solution_b (the reference fetches without order).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codescope.functions.text import normalize_code
from codescope.operators import pair_cells as PC
from codescope.operators.pair_cells import BLOCK, cells, combined, scored
from codescope.sources.scratch import materialise


# ------------------------------------------------------------------ scalars
def token_counts(code: DataFrame) -> DataFrame:
    """(solution_id, word, n) of the normalised sources (X8 runs JVM-side first)."""
    words = F.split(normalize_code(F.col("code")), r"\s+")
    return (code.select("solution_id", F.explode(words).alias("word")).where("word <> ''")
                .groupBy("solution_id", "word").agg(F.count(F.lit(1)).alias("n")))


def _texts(code: DataFrame) -> DataFrame:
    """``code`` with the normalised ``text`` as bytes in its place, where there is one; normalised once, not for a filter too."""
    return code.where("code IS NOT NULL").withColumn("text", normalize_code(F.col("code")).cast("binary")).drop("code")


def _overlaps(keys: np.ndarray, texts: pa.Array, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """X11 of pairs of keys, for the texts of one key as one; a key without a text has no words."""
    docs, doc = np.unique(keys, return_inverse=True)
    split = [(t or b"").split() for t in texts.to_pylist()]  # the ASCII blanks of \s
    words = pa.array([w for own in split for w in own], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    at = np.array([len(own) for own in split], np.int64)
    sides = []
    for side in (x, y):
        place = np.minimum(np.searchsorted(docs, side), max(len(docs) - 1, 0))
        sides.append(np.where(docs[place] == side, place, len(docs)) if len(docs) else np.zeros(len(side), np.int64))
    both, size = PC.shared_counts(np.repeat(doc, at), words, len(docs) + 1, *sides)
    total = size[sides[0]] + size[sides[1]]
    # rows that repeat a pair count together
    _, same, times = np.unique(sides[0] * (len(docs) + 1) + sides[1], return_inverse=True, return_counts=True)
    return np.where(total == 0, 1.0, 2.0 * (both * times[same]) / np.maximum(total, 1))


def token_similarity(pairs: DataFrame, code: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """X11: 2·Σ min(n_a, n_b) / (|a| + |b|) over the words of the normalised sources, per pair.

    The share of matching tokens; two sources without words are equal (1.0). Adds ``token_similarity``. Sources meet
    in cells of pairs (``dealt``: ``pair_cells.cells`` of them), so a text travels about once and words never become rows of pairs.
    Pairs with a ``cell`` meet the ``code`` of :func:`in_cells`.
    """
    if "cell" in pairs.columns:
        def overlap(keys, kinds, payloads, x, y):
            return np.arange(len(x)), [_overlaps(keys, payloads["text"], x, y)]

        return PC.in_cells(pairs, {PC.TEXT: _texts(code)}, overlap, "token_similarity double")
    if dealt is None:
        pairs = materialise(pairs, "pairs")
        dealt = cells(pairs)
    texts = _texts(code)

    def overlaps(members, pairs):
        at, docs = {}, []
        for s, text in zip(members[0].to_pylist(), members[1]):
            if s not in at:  # rows that repeat an id count together
                at[s] = len(docs)
                docs.append(Counter())
            docs[at[s]].update((text.as_py() or b"").split())  # the ASCII blanks of \s
        x, y = (np.array([at[s] for s in side.tolist()], np.int64) for side in pairs[:2])
        size = np.array([d.total() for d in docs], np.int64)
        return pairs[0], pairs[1], combined(docs, x, y, np.minimum) * pairs[2], size[x] + size[y]

    kind = dict(pairs.dtypes)["solution_a"]
    same = scored(dealt, texts, "text", overlaps, f"solution_a {kind}, solution_b {kind}, _m bigint, _t bigint")
    out = pairs.join(same.hint("merge"), ["solution_a", "solution_b"], "left")
    total = F.coalesce("_t", F.lit(0))
    rest = [c for c in pairs.columns if c not in ("solution_a", "solution_b")]
    return out.select("solution_b", "solution_a", *rest, F.when(total == 0, F.lit(1.0)).otherwise(
        2.0 * F.coalesce("_m", F.lit(0)) / total).alias("token_similarity"))


def _dot(a: Column, b: Column) -> Column:
    """Dot over the shorter length (zip_with pads with NULL → 0)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0),
                       lambda acc, v: acc + v)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + F.coalesce(v * v, F.lit(0.0))))


def embedding_similarity(va: Column, vb: Column) -> Column:
    """Cosine, zero norm → 0.0, clamped to [-1, 1]; NULL unless both vectors exist."""
    na, nb = _norm(va), _norm(vb)
    cos = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), _dot(va, vb) / (na * nb))))
    return F.when(va.isNotNull() & vb.isNotNull(), cos)


# ------------------------------------------------------------------ AST histograms
def _counts(types: Column) -> Column:
    return F.map_from_entries(F.transform(types, lambda t: F.struct(t["node_type"], t["n"])))


def _length(types: Column) -> Column:
    return F.sqrt(F.aggregate(types, F.lit(0).cast("long"), lambda acc, t: acc + t["n"] * t["n"]))


def _histogram_cosine(types_a: Column, norm_a: Column, error_a: Column, counts_b: Column, norm_b: Column, error_b: Column) -> Column:
    dot = F.aggregate(types_a, F.lit(0).cast("long"),
                      lambda acc, t: acc + t["n"] * F.coalesce(F.try_element_at(counts_b, t["node_type"]), F.lit(0)))
    cos = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot.cast("double"), norm_a * norm_b)))
    return (F.when(error_a.isNotNull() | error_b.isNotNull(), F.lit(0.0))
             .when((F.size(types_a) == 0) & (F.size(counts_b) == 0), F.lit(1.0))
             .otherwise(F.coalesce(cos, F.lit(0.0))))


def ast_cosine(types_a: Column, error_a: Column, types_b: Column, error_b: Column) -> Column:
    """Cosine of two node histograms, clamped to [0, 1]; a parse error on either side gives 0.0.

    The union of node types (E3) needs no rows: types of one side only add nothing to the product.
    """
    return _histogram_cosine(types_a, _length(types_a), error_a, _counts(types_b), _length(types_b), error_b)


def _histograms(facts: DataFrame) -> DataFrame:
    """``facts`` with the counts of its node types and whether the parse failed."""
    entry = F.transform("types", lambda t: F.struct(t["node_type"].alias("node_type"), t["n"].alias("n")))
    return facts.select(*[c for c in facts.columns if c not in ("types", "parse_error")], entry.alias("types"), F.col("parse_error").isNotNull().alias("failed"))


def _cosines(keys: np.ndarray, types: pa.Array, failed: pa.Array, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """X12 of the pairs ``i`` of keys, once for all rows of both keys; a key without a row has an empty histogram."""
    i, u, v = PC.each_with(i, x, y, keys)
    flat = types.flatten()
    doc = np.repeat(np.arange(len(keys)), pc.fill_null(types.value_lengths(), 0).to_numpy())
    kind = flat.field("node_type").dictionary_encode().indices.to_numpy()
    dot, square = PC.products(doc, kind, flat.field("n").to_numpy(), len(keys) + 1, u, v)
    failed = np.append(pc.fill_null(failed, False).to_numpy(zero_copy_only=False), False)
    norm = np.sqrt(square.astype(float))
    scale = norm[u] * norm[v]
    cos = np.minimum(1.0, dot / np.where(scale > 0, scale, 1.0))
    return i, np.where(failed[u] | failed[v], 0.0, np.where((norm[u] == 0) & (norm[v] == 0), 1.0, cos))


def pair_ast_similarity(pairs: DataFrame, facts: DataFrame, dealt: DataFrame | None = None) -> DataFrame:
    """J7 + X12: adds ``ast_similarity`` to (solution_a, solution_b) pairs.

    ``facts`` is ``codefacts.source_facts``; histograms meet in cells of pairs (``dealt``: ``pair_cells.cells`` of them), so one
    travels about once. Pairs with a ``cell`` meet facts that carry the ``cells`` of :func:`in_cells`.
    """
    if "cell" in pairs.columns:
        def cosine(keys, kinds, payloads, x, y):
            i, cos = _cosines(keys, payloads["types"], payloads["failed"], np.arange(len(x)), x, y)
            return i, [cos]

        return PC.in_cells(pairs, {PC.TYPES: _histograms(facts)}, cosine, "ast_similarity double")
    if dealt is None:
        dealt = cells(pairs, written=False)  # building the query runs no job
    counts = _histograms(facts).select("solution_id", F.struct("types", "failed").alias("counts"))

    def cosines(members, pairs):
        at: dict = {}
        docs, failed = [], []
        for s, c in zip(members[0].to_pylist(), members[1].to_pylist()):
            at.setdefault(s, []).append(len(docs))
            docs.append({t["node_type"]: t["n"] for t in c["types"] or ()} if c else {})
            failed.append(bool(c and c["failed"]))
        rows = [(i, u, v) for i, (p, q) in enumerate(zip(pairs[0].tolist(), pairs[1].tolist())) for u in at[p] for v in at[q]]
        i, x, y = (np.array(c, np.int64) for c in zip(*rows))
        norm = np.sqrt(np.array([sum(n * n for n in d.values()) for d in docs], float))
        failed, empty = np.array(failed), norm == 0
        scale = norm[x] * norm[y]
        cos = np.minimum(1.0, combined(docs, x, y, np.multiply) / np.where(scale > 0, scale, 1.0))
        cos = np.where(failed[x] | failed[y], 0.0, np.where(empty[x] & empty[y], 1.0, cos))
        return pairs[0][i], pairs[1][i], cos

    kind = dict(pairs.dtypes)["solution_a"]
    same = scored(dealt, counts, "counts", cosines, f"solution_a {kind}, solution_b {kind}, ast_similarity double")
    rest = [c for c in pairs.columns if c not in ("solution_a", "solution_b")]
    return pairs.join(same.hint("merge"), ["solution_a", "solution_b"], "left").select("solution_b", "solution_a", *rest, "ast_similarity")


# ------------------------------------------------------------------ pair shapes
def representatives(solutions: DataFrame) -> DataFrame:
    """First-appearing solution per (prompt, model): W3 by smallest solution_id; and their number ``n``."""
    return (solutions.groupBy("prompt_id", "model")
                     .agg(F.min("solution_id").alias("solution_id"), F.count(F.lit(1)).alias("n")))


def _with_representatives(solutions: DataFrame) -> DataFrame:
    """``solutions`` with the representatives of the prompt (``_reps``, at most one a model), in how many blocks (``_blocks``, ``_rep_blocks``)
    its solutions and representatives are, and for how many models the id is one (``_own``; more than 1 where an id repeats)."""
    prompts = representatives(solutions).groupBy("prompt_id").agg(
        F.collect_list(F.struct("model", "solution_id")).alias("_reps"), F.ceil(F.sum("n") / BLOCK).alias("_blocks"))
    rows = solutions.join(prompts.withColumn("_rep_blocks", F.ceil(F.size("_reps") / BLOCK)), "prompt_id")
    return rows.withColumn("_own", F.size(F.filter("_reps", lambda r: r["solution_id"] == F.col("solution_id"))))


def _block(solution: Column, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(blocks), solution), F.col(blocks))


def in_cells(solutions: DataFrame) -> DataFrame:
    """``solutions`` with the ``cells`` whose :func:`coverage_pairs` (``dealt``) name them, spread by the id.

    A prompt's solutions and its representatives are dealt to blocks of about ``BLOCK`` by a hash; a cell is one block of each. So a small prompt is
    one cell, and of a large one a solution goes to its own block's cells, and only representatives to all. Rows without a prompt or id have no pairs and go.
    """
    rows = _with_representatives(solutions).where("solution_id IS NOT NULL")
    at, rep_at = _block(F.col("solution_id"), "_blocks"), _block(F.col("solution_id"), "_rep_blocks")

    def upto(blocks, cell):
        return F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1), cell)

    own = upto("_rep_blocks", lambda j: F.xxhash64("prompt_id", F.col("_at"), j))
    every = upto("_blocks", lambda j: F.xxhash64("prompt_id", j, F.col("_rep_at")))
    found = F.when((F.col("_blocks") == 1) & (F.col("_rep_blocks") == 1), F.array(F.xxhash64("prompt_id", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))))
    found = found.when(F.col("_own") == 0, own).otherwise(F.array_union(own, every))
    return rows.withColumns({"_at": at, "_rep_at": rep_at}).select(*solutions.columns, found.alias("cells")).repartition(
        PC.shares(solutions.sparkSession), "solution_id")


def coverage_pairs(solutions: DataFrame, dealt: bool = False) -> DataFrame:
    """J3 (linear): every solution with the representative of each model of its prompt.

    Equi join on prompt_id with its at most #models representatives; a pair of two representatives appears once. An id belongs to one
    prompt. ``dealt`` adds the ``cell`` where the pair meets the payloads of :func:`in_cells`.
    """
    s, rep = F.col("solution_id"), F.col("_rep.solution_id")
    rows = _with_representatives(solutions.select("prompt_id", "solution_id", "model"))
    rows = rows.withColumn("_met", F.filter("_reps", lambda r: (s < r["solution_id"]) | ((s > r["solution_id"]) & (F.col("_own") == 0))))
    # an id that stands for several models meets the others as often
    rows = rows.withColumn("_met", F.when(F.col("_own") > 1, F.flatten(F.array_repeat("_met", F.col("_own")))).otherwise(F.col("_met")))
    cell = [F.xxhash64("prompt_id", _block(s, "_blocks"), _block(rep, "_rep_blocks")).alias("cell")] if dealt else []
    first = s < rep
    return rows.withColumn("_rep", F.explode("_met")).select(
        "prompt_id", F.least(s, rep).alias("solution_a"), F.greatest(s, rep).alias("solution_b"),
        F.when(first, F.col("model")).otherwise(F.col("_rep.model")).alias("model_a"),
        F.when(first, F.col("_rep.model")).otherwise(F.col("model")).alias("model_b"), *cell)


def similarity_report(pairs: DataFrame, code: DataFrame, facts: DataFrame | None,
                      vectors: DataFrame | None) -> DataFrame:
    """Token, AST and embedding similarity per pair.

    ``code``: (solution_id, code); ``facts``: ``source_facts``; ``vectors``: (solution_id, vector). The
    embedding column is NULL unless both sides have a vector. Pairs with a ``cell`` meet ``code`` and ``facts`` that carry
    the ``cells`` of :func:`in_cells`, all three scores in one pass.
    """
    if "cell" in pairs.columns:
        return _report_in_cells(pairs, code, facts, vectors)
    pairs = materialise(pairs, "pairs")
    dealt = cells(pairs)
    out = token_similarity(pairs, code, dealt)
    if facts is not None:
        out = pair_ast_similarity(out, facts, dealt)
    if vectors is not None:
        va = vectors.select(F.col("solution_id").alias("solution_a"), F.col("vector").alias("va"))
        vb = vectors.select(F.col("solution_id").alias("solution_b"), F.col("vector").alias("vb"))
        out = (out.join(va, "solution_a", "left").join(vb, "solution_b", "left")
                  .withColumn("embedding_similarity", embedding_similarity(F.col("va"), F.col("vb")))
                  .drop("va", "vb"))
    return out


def _report_in_cells(pairs: DataFrame, code: DataFrame, facts: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    members, schema = {PC.TEXT: _texts(code)}, "token_similarity double"
    if facts is not None:
        members[PC.TYPES] = _histograms(facts)
        schema += ", ast_similarity double"
    if vectors is not None:
        at = code.select("solution_id", F.explode("cells").alias("cell")).distinct()
        members[PC.VECTOR] = vectors.select("solution_id", F.col("vector").cast("array<double>").alias("vector")).join(at, "solution_id").select(
            "solution_id", F.array("cell").alias("cells"), "vector")
        schema += ", va array<double>, vb array<double>"
    with_facts, with_vectors = facts is not None, vectors is not None

    def scores(keys, kinds, payloads, x, y):
        def of(kind):
            rows = np.flatnonzero(kinds == kind)
            return keys[rows], lambda name: payloads[name].take(pa.array(rows))

        i, out = np.arange(len(x)), []
        own, column = of(PC.TEXT)
        out.append(_overlaps(own, column("text"), x, y))
        if with_facts:
            own, column = of(PC.TYPES)
            i, cos = _cosines(own, column("types"), column("failed"), i, x, y)
            out = [out[0][i], cos]
        if with_vectors:
            own, column = of(PC.VECTOR)
            at, u, v = PC.each_with(np.arange(len(i)), x[i], y[i], own)
            none = (u == len(own)) | (v == len(own))  # a vector travels on only where both are there
            i, out = i[at], [c[at] for c in out]
            out += [column("vector").take(pa.array(side, mask=none)) for side in (u, v)]
        return i, out

    out = PC.in_cells(pairs, members, scores, schema)
    if vectors is not None:
        out = out.withColumn("embedding_similarity", embedding_similarity(F.col("va"), F.col("vb"))).drop("va", "vb")
    return out


def model_pair_similarity(solutions: DataFrame, facts: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """J3 exact aggregate: mean AST / embedding cosine per (prompt, model_a ≤ model_b).

    ``solutions``: (solution_id, prompt_id, model); ``facts``: ``codefacts.source_facts``, whose unparsable
    sources have no node types (their cosine is 0 with everything, matching the per-pair rule), or ``solution_facts``
    that carry the prompt and model, which need no join.
    """
    sol = solutions.select("solution_id", "prompt_id", "model")
    counts = sol.groupBy("prompt_id", "model").agg(F.count(F.lit(1)).alias("n"))
    # unit histograms, summed per (prompt, model, node_type); the pseudo type '' counts the parsed sources
    norm = F.sqrt(F.aggregate("types", F.lit(0).cast("long"), lambda acc, t: acc + t["n"] * t["n"]))
    units = facts.where(F.size("types") > 0).select(*[c for c in ("solution_id", "prompt_id", "model") if c in facts.columns], F.concat(
        F.array(F.struct(F.lit("").alias("node_type"), F.lit(1.0).alias("u"))),
        F.transform("types", lambda t: F.struct(t["node_type"].alias("node_type"), (t["n"] / norm).alias("u")))).alias("units"))
    # the session's partitions, given as a number: small shuffled bytes may be many rows, so a task's share is not to be
    # coalesced; known without a job
    parts = int(solutions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # node types become rows after the join, for the sums
    units = units if "model" in facts.columns else units.repartition(parts, "solution_id").join(sol.repartition(parts, "solution_id"), "solution_id")
    unit = units.select("prompt_id", "model", F.explode("units").alias("x")).select("prompt_id", "model", "x.node_type", "x.u")
    # one row per (prompt, model) with its summed vector, some tens of node types long
    v = (unit.groupBy("prompt_id", "model", "node_type").agg(F.sum("u").alias("s")).repartition(parts, "prompt_id")
             .groupBy("prompt_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("node_type", "s"))).alias("v")))
    sums = counts.repartition(parts, "prompt_id").join(v.hint("merge"), ["prompt_id", "model"], "left")
    if vectors is not None:
        vec = vectors.join(sol, "solution_id").withColumn("_norm", _norm(F.col("vector")))
        vec = vec.withColumn("_u", F.when(F.col("_norm") > 0, F.transform("vector", lambda x: x / F.col("_norm")))
                                    .otherwise(F.transform("vector", lambda x: F.lit(0.0))))
        e = (vec.groupBy("prompt_id", "model")
                .agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("_u")))).alias("e"),
                     F.count(F.lit(1)).alias("m"), F.count_if(F.col("_norm") > 0).alias("mq")))
        sums = sums.join(e.repartition(parts, "prompt_id").hint("merge"), ["prompt_id", "model"], "left")
    a, b = (sums.select("prompt_id", *[F.col(c).alias(f"{c}_{side}") for c in sums.columns if c != "prompt_id"]) for side in "ab")
    pairs = a.join(b.hint("merge"), "prompt_id").where(F.col("model_a") <= F.col("model_b"))
    same = F.col("model_a") == F.col("model_b")
    n_pairs = F.when(same, F.col("n_a") * (F.col("n_a") - 1) / 2).otherwise(F.col("n_a") * F.col("n_b"))
    dot = F.coalesce(F.aggregate(F.filter(F.map_entries("v_a"), lambda e: e["key"] != ""), F.lit(0.0),
                                 lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(F.col("v_b"), e["key"]), F.lit(0.0))), F.lit(0.0))
    parsed = F.coalesce(F.try_element_at("v_a", F.lit("")).cast("long"), F.lit(0))
    pair_sum = F.when(same, (dot - parsed) / 2).otherwise(dot)
    out = pairs.withColumn("n_pairs", n_pairs.cast("long")).where(F.col("n_pairs") > 0).withColumn(
        "ast_similarity_mean", pair_sum / F.col("n_pairs"))
    cols = ["prompt_id", "model_a", "model_b", "n_pairs", "ast_similarity_mean"]
    if vectors is not None:
        edot = _dot(F.col("e_a"), F.col("e_b"))
        m_pairs = F.when(same, F.col("m_a") * (F.col("m_a") - 1) / 2).otherwise(F.col("m_a") * F.col("m_b"))
        esum = F.when(same, (edot - F.col("mq_a")) / 2).otherwise(edot)
        out = (out.withColumn("n_embedding_pairs", F.coalesce(m_pairs, F.lit(0)).cast("long"))
                  .withColumn("embedding_similarity_mean",
                              F.when(F.col("n_embedding_pairs") > 0, esum / F.col("n_embedding_pairs"))))
        cols += ["n_embedding_pairs", "embedding_similarity_mean"]
    return out.select(*cols)


# ------------------------------------------------------------------ native alternatives to X11
SHINGLE = 3


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """JVM-side alternative to the character ratio: 1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def shingles(text: Column, k: int = SHINGLE) -> Column:
    """Distinct character k-grams (texts shorter than k give themselves)."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))),
                        lambda i: F.substring(text, i, k))
    return F.array_distinct(grams)


def shingle_jaccard(a: Column, b: Column, k: int = SHINGLE) -> Column:
    """JVM-side alternative: Jaccard of character k-gram sets (two empty texts → 1.0)."""
    sa, sb = shingles(a, k), shingles(b, k)
    union = F.size(F.array_union(sa, sb))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(sa, sb)) / union)
