"""Near-duplicate embeddings by NN-descent.

* **Classes.** Equal vectors are one node with a count (partial counts before the shuffle).
* **Starting lists.** Nodes are sorted by the bits of seeded random hyperplanes, in several tables; each is compared with
  the ``WINDOW`` nodes before and after it. There are no buckets, so no bucket can be hot. Vectors travel as bytes
  (``d`` of them), and similarities are approximate up to the last step.
* **Descent.** Each round joins the neighbours of a node with each other: its list and the best ``REVERSE`` nodes that list
  it, where at least one of the two is new. A pair travels only if it would enter a list. The best entries of each
  list are kept, in each task before the shuffle and after it.
* **Saturation.** A list that is full of near entries may hide others: it doubles, up to ``LIST_MOST``.
* **Audit.** ``AUDIT`` nodes are compared with all others by brute force; while less than ``WANTED`` of their links lie
  within the components of the graph, more tables are added and the descent goes on.
* **Threshold edges.** The graph's edges down to ``MARGIN`` below the threshold give groups. Within each group all links
  are counted exactly, in double precision: the group is cut into blocks of ``BLOCK`` nodes, a task multiplies two of
  them and returns a count for each node and a spanning forest, never the pairs. So a full list hides no link, and
  what the search may miss is only a link between two groups that no chain of found edges connects.

Defined results: vectors that are null, empty, zero, or hold null or non-finite entries link with nothing, as do
vectors of different width. Rows with one vector are linked with each other; a missing id counts as a row and is never the
smallest, unless no row of its component has an id. Ties in lists go to the smaller node. An empty table gives an
empty frame; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import join_copies, map_batches, materialise, placed, table
from codescope.operators.components import components

TABLES, BITS, WINDOW, START = 8, 60, 12, 4
LIST, LIST_MOST, REVERSE, EMIT = 12, 48, 12, 3
ROUNDS, EXTRA = 4, 3
#: Bytes stand for a vector during the search: their cosine is within ``MARGIN`` of the true one.
MARGIN = 0.03
AUDIT, WANTED = 1024, 0.99
BLOCK, STEP = 4096, 512

EDGES = "node bigint, nbr bigint, cos float, fresh boolean, cap int"


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows whose vector has a direction; ``v`` is null for the others."""
    v = F.transform("embedding", lambda e: e.cast("double"))
    rows = rows.select("vec_id", v.alias("v"))
    fine = F.forall("v", lambda e: F.coalesce(F.abs(e) < F.lit(float("inf")), F.lit(False))) & F.exists("v", lambda e: e != 0)
    return rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("v")).alias("v"))


def _rows(column, dtype=float) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(column), -1)


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _bytes_units(column) -> np.ndarray:
    """Unit vectors from the byte form."""
    rows = column.to_pylist()
    q = np.frombuffer(b"".join(rows), np.int8).astype(np.float32).reshape(len(rows), -1)
    return q / np.sqrt((q * q).sum(1, keepdims=True))


def byte_form(nodes: DataFrame) -> DataFrame:
    """``node, q``: a signed byte for each entry, the largest 127."""

    def run(batches):
        for b in batches:
            v = _rows(b.column(1))
            q = np.rint(v / np.abs(v).max(1, keepdims=True) * 127).astype(np.int8)
            yield {"node": b.column(0), "q": [r.tobytes() for r in q]}

    return map_batches(nodes.select("node", "v"), run, "node bigint, q binary")


def _starts(node: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)


def _best_of(node, nbr, cos, fresh, cap, room: int = 0):
    """The best entries of each node, as many as the largest ``cap`` of its rows, or ``room``.

    Of repeated entries the old one stays, as its neighbours were joined already.
    """
    order = np.lexsort((fresh, nbr, node))
    node, nbr, cos, fresh, cap = (x[order] for x in (node, nbr, cos, fresh, cap))
    first = _starts(node)
    if len(first):
        cap = np.repeat(np.maximum.reduceat(cap, first), np.diff(np.append(first, len(node))))
    keep = np.ones(len(node), bool)
    keep[1:] = (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])
    node, nbr, cos, fresh, cap = (x[keep] for x in (node, nbr, cos, fresh, cap))
    order = np.lexsort((nbr, -cos, node))
    node, nbr, cos, fresh, cap = (x[order] for x in (node, nbr, cos, fresh, cap))
    first = _starts(node)
    rank = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
    keep = rank < (room or cap)
    return [x[keep] for x in (node, nbr, cos, fresh, cap)]


def _columns(b) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in b.columns]


def _runs(batches):
    """Record batches cut so that the rows of one value of the first column, which sorts them, stay together."""
    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = held.column(0).to_numpy()
        k = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if k:
            yield held.slice(0, k).combine_chunks().to_batches()[0]
            held = held.slice(k)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


NAMES = [f.split()[0] for f in EDGES.split(", ")]


def _dealt(df: DataFrame, key: str) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key)


def best(edges: DataFrame, near: float) -> DataFrame:
    """The neighbour lists of ``EDGES``; a list that is full of entries from ``near`` up has twice the room afterwards."""

    def local(batches):  # no node sends more than a list from a batch
        for b in batches:
            yield dict(zip(NAMES, _best_of(*_columns(b), room=LIST_MOST)))

    def run(batches):
        for b in _runs(batches):
            node, nbr, cos, fresh, cap = _best_of(*_columns(b))
            first = _starts(node)
            size = np.diff(np.append(first, len(node)))
            full = (size >= cap[first]) & (np.minimum.reduceat(cos, first) >= near)
            yield dict(zip(NAMES, (node, nbr, cos, fresh, np.where(np.repeat(full, size), np.minimum(2 * cap, LIST_MOST), cap))))

    return materialise(map_batches(_dealt(map_batches(edges, local, EDGES), "node"), run, EDGES), "graph")


def started(q: DataFrame, width: int, first: int) -> DataFrame:
    """Candidate ``EDGES`` of ``TABLES`` sorted tables, from table ``first`` on."""
    planes = np.random.default_rng([42, first]).standard_normal((width, TABLES * BITS)).astype(np.float32)
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def codes(batches):
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                bits = (_bytes_units(part.column(1)) @ planes > 0).reshape(-1, TABLES, BITS)
                code = (bits * weights).sum(2)
                yield {"t": np.tile(np.arange(TABLES, dtype=np.int32), len(code)), "code": code.ravel(),
                       "node": np.repeat(part.column(0).to_numpy(), TABLES),
                       "q": pa.array(part.column(1).to_pylist(), pa.binary()).take(pa.array(np.repeat(np.arange(len(code)), TABLES)))}

    def windows(batches):
        held = None
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                now = part.column(0).to_numpy(), part.column(1).to_numpy(), _bytes_units(part.column(2))
                t, node, v = now if held is None else (np.concatenate(x) for x in zip(held, now))
                new = len(node) - part.num_rows
                cos = np.full((len(node), 2 * WINDOW), -2, np.float32)
                other = np.zeros((len(node), 2 * WINDOW), np.int64)
                for o in range(1, min(WINDOW, len(node) - 1) + 1):
                    x = np.arange(max(0, new - o), len(node) - o)
                    x = x[t[x] == t[x + o]]
                    c = (v[x] * v[x + o]).sum(1)
                    cos[x, o - 1], other[x, o - 1] = c, node[x + o]
                    cos[x + o, WINDOW + o - 1], other[x + o, WINDOW + o - 1] = c, node[x]
                top = np.argpartition(-cos, START - 1, 1)[:, :START]
                c = np.take_along_axis(cos, top, 1).ravel()
                keep = c > -2
                yield _candidates(np.repeat(node, START)[keep], np.take_along_axis(other, top, 1).ravel()[keep], c[keep])
                held = t[-WINDOW:], node[-WINDOW:], v[-WINDOW:]

    # written: a range partitioning reads its input twice
    coded = materialise(map_batches(q, codes, "t int, code bigint, node bigint, q binary"), "codes")
    parts = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = coded.repartitionByRange(parts, "t", "code", "node").sortWithinPartitions("t", "code", "node")
    return map_batches(ranged.select("t", "node", "q"), windows, EDGES)


def _candidates(node, nbr, cos) -> dict:
    return {"node": node, "nbr": nbr, "cos": cos, "fresh": np.ones(len(node), bool), "cap": np.full(len(node), LIST, np.int32)}


def joined(graph: DataFrame, q: DataFrame) -> DataFrame:
    """Candidate ``EDGES`` among the neighbours of each node: pairs with a new neighbour that would enter a list."""

    def reverse_local(batches):  # the best nodes that list a node, few from each batch
        for b in batches:
            node, nbr, cos, fresh, cap = _columns(b)
            yield dict(zip(NAMES, _best_of(nbr, node, cos, fresh, cap, room=REVERSE)))

    def reverse(batches):
        for b in _runs(batches):
            yield dict(zip(NAMES, _best_of(*_columns(b), room=REVERSE)))

    back = map_batches(_dealt(map_batches(graph, reverse_local, EDGES), "node"), reverse, EDGES)
    around = graph.select("node", "nbr", "fresh").unionByName(back.select("node", "nbr", "fresh")).groupBy("node", "nbr").agg(
        F.max("fresh").alias("fresh"))
    worst = graph.groupBy("node").agg(F.when(F.count("*") >= F.max("cap"), F.min("cos")).otherwise(F.lit(-2.0)).cast("float").alias("worst"))
    info = q.join(worst, "node", "left").select(F.col("node").alias("nbr"), "q", F.coalesce("worst", F.lit(-2.0).cast("float")).alias("worst"))

    def run(batches):
        for b in _runs(batches):
            at, node, fresh, worst = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            v, first = _bytes_units(b.column(3)), _starts(at)
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
            for lo, hi in zip(first, np.append(first[1:], len(at))):
                new = fresh[lo:hi]
                if hi - lo < 2 or not new.any():
                    continue
                cos = v[lo:hi] @ v[lo:hi].T
                np.fill_diagonal(cos, -2)
                cos[~(new[:, None] | new)] = -2
                cos[cos <= worst[lo:hi, None]] = -2
                top = np.argpartition(-cos, min(EMIT, hi - lo) - 1, 1)[:, :EMIT]
                c = np.take_along_axis(cos, top, 1)
                x, y = np.nonzero(c > -2)
                out.append((node[lo + x], node[lo + top[x, y]], c[x, y]))
            yield _candidates(*(np.concatenate(x) for x in zip(*out)))

    rows = around.join(info, "nbr").select("node", "nbr", "fresh", "q", "worst")
    return map_batches(_dealt(rows, "node"), run, EDGES)


def groups_of(graph: DataFrame, near: float) -> DataFrame:
    """``node, label`` of the components of the graph's edges from ``near`` up, without lone nodes."""
    return materialise(components(graph.where(F.col("cos") >= F.lit(near)).select(F.col("node").alias("a"), F.col("nbr").alias("b"))), "groups")


def audit(nodes: DataFrame, groups: DataFrame, threshold: float) -> float:
    """The share of the links of ``AUDIT`` nodes, found by brute force, that lie within groups."""
    labelled = materialise(nodes.select("node", "v").join(groups, "node", "left"), "labelled")
    asked = labelled.orderBy(F.xxhash64("node")).limit(AUDIT).collect()  # a fixed number of vectors
    who, label = np.array([r.node for r in asked]), np.array([r.node if r.label is None else r.label for r in asked])
    theirs = _units(np.array([r.v for r in asked]))

    def run(batches):
        links, found = 0, 0
        for b in batches:
            for k in range(0, b.num_rows, STEP):
                part = b.slice(k, STEP)
                node = part.column(0).to_numpy()
                own = part.column(2).fill_null(-1).to_numpy()
                hit = (_units(_rows(part.column(1))) @ theirs.T >= threshold) & (node[:, None] != who)
                links += int(hit.sum())
                found += int((hit & (own[:, None] == label)).sum())
        yield {"links": [links], "found": [found]}

    total = map_batches(labelled, run, "links bigint, found bigint").agg(F.sum("links"), F.sum("found")).first()
    return total[1] / total[0] if total[0] else 1.0


def search(nodes: DataFrame, width: int, threshold: float) -> tuple[DataFrame, float]:
    """``node, label`` of groups that hold the links of ``nodes`` (``node, v``), and the audited recall."""
    near = threshold - MARGIN
    q = materialise(byte_form(nodes), "bytes")
    graph, reached = best(started(q, width, 0), near), -1
    for extra in range(EXTRA + 1):
        for _ in range(ROUNDS):
            graph = best(graph.withColumn("fresh", F.lit(False)).unionByName(joined(graph, q)), near)
            now = graph.where(F.col("cos") >= F.lit(near)).select("node").distinct().count()
            if now <= 1.001 * reached or not now:  # no more nodes have a near neighbour
                break
            reached = now
        groups = groups_of(graph, near)
        recall = audit(nodes, groups, threshold)
        if recall >= WANTED or extra == EXTRA:
            return groups, recall
        graph, reached = best(graph.unionByName(started(q, width, (extra + 1) * TABLES)), near), -1


def counted(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` for pairs of blocks of a group: links of a node (each weighs its ``copies``) and a tree edge."""
    rows = placed(groups.join(nodes.select("node", "v", "copies"), "node"), "label", ["node"]).withColumn("block", F.floor(F.col("pos") / BLOCK))
    last = rows.groupBy("label").agg(F.max("block").alias("last"))
    rows = rows.join(last, "label")
    one = rows.select("label", "node", "v", "copies", F.col("block").alias("i"), F.explode(F.sequence("block", "last")).alias("j"), F.lit(0).alias("side"))
    two = rows.where("block > 0").select("label", "node", "v", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("block") - 1)).alias("i"),
                                         F.col("block").alias("j"), F.lit(1).alias("side"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("side", "ascending"), ("node", "ascending")]).combine_chunks()
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        v, cut = _units(_rows(t.column("v").combine_chunks())), int((t.column("side").to_numpy() == 0).sum())
        a, b = (slice(0, cut), slice(cut, len(node))) if cut < len(node) else (slice(0, cut), slice(0, cut))
        hit = np.concatenate([v[a][k:k + STEP] @ v[b].T >= threshold for k in range(0, cut, STEP)])
        links = np.zeros(len(node), np.int64)
        if cut == len(node):
            np.fill_diagonal(hit, False)
        else:
            links[b] += copies[a] @ hit
        links[a] += hit @ copies[b]
        root = np.arange(len(node))  # smallest row that a row reaches
        while True:
            low = root.copy()
            for k in range(0, cut, STEP):
                low[a][k:k + STEP] = np.minimum(low[a][k:k + STEP], np.where(hit[k:k + STEP], root[b], len(node)).min(1))
                low[b] = np.minimum(low[b], np.where(hit[k:k + STEP], root[a][k:k + STEP, None], len(node)).min(0))
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pa.table({"node": node, "links": links, "root": node[root]})

    return materialise(one.unionByName(two).groupBy("label", "i", "j").applyInArrow(run, "node bigint, links bigint, root bigint"), "counted")


def near_vectors(rows: DataFrame, threshold: float = 0.95) -> tuple[DataFrame, list[float]]:
    """``vec_id, n_links, component_id, kept`` for each row of ``rows`` (``vec_id, embedding``), and the audited recalls.

    ``n_links`` counts the other rows with a cosine of at least ``threshold``; ``component_id`` is the smallest id of those
    that links reach.
    """
    whole = materialise(usable(rows), "vectors")
    alone = whole.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out, recalls = alone, []
    whole = whole.where("v is not null").withColumn("d", F.size("v"))
    for width in sorted(r.d for r in whole.select("d").distinct().collect()):  # a table has one width, as a rule
        own = whole.where(F.col("d") == width).select("vec_id", "v")
        nodes = materialise(own.groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
                            .withColumn("node", F.monotonically_increasing_id()), "nodes")
        groups, recall = search(nodes.select("node", "v"), width, threshold)
        pairs = counted(nodes, groups, threshold)
        links = pairs.groupBy("node").agg(F.sum("links").alias("links"))
        label = materialise(components(pairs.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))), "labels")
        ids = nodes.select("node", "first").join(label, "node").groupBy("label").agg(F.min("first").alias("smallest"))
        found = materialise(nodes.join(links, "node", "left").join(label.join(ids, "label"), "node", "left").select(
            "v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.when(F.col("label").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id")), "found")
        total = own.count()
        out = out.unionByName(join_copies(own, found, "v", total).select("vec_id", "n_links", "component_id"))
        recalls.append(recall)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recalls


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector under cosines of 0.95 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))[0]


def op11_sql() -> str:
    """Brute force over all pairs, then the smallest reachable id."""
    return """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = r.vec_id) AS n_links, min(c) AS component_id, vec_id = min(c) AS kept
FROM r GROUP BY vec_id"""
