"""Merkle manifest of a data set by butterfly exchange.

Rows are leaves of one tree for each group; the groups' roots are leaves of one more tree. While several nodes of a
tree remain, every ``FANOUT`` consecutive ones (the last run may be shorter, even one) become the hash of their digests.

* **Places.** Leaves are range-partitioned by group and order, and written; a leaf's place is its number in its
  partition plus what earlier partitions hold of its group. No group is sorted in one task.
* **Aligned partitions.** ``FANOUT ** HEIGHT`` consecutive leaves are one aligned partition of the tree. Each is hashed
  up to its own subtree root by itself, so a task holds ``FANOUT ** HEIGHT`` digests however large the group is.
* **Butterfly.** In round ``r`` a partition ``p`` knows the ancestor that covers ``FANOUT ** r`` partitions. It swaps it
  with the partitions of the same rank below the sibling ancestors, hashes the common parent itself (its peers do the same,
  redundantly) and keeps the siblings. After the last round each partition holds the root and all its upper proof, with
  no pass downwards. Below a ragged last ancestor one partition serves several ranks; no other row is repeated. A round
  is one shuffle of a row or so for each partition.

Defined results: a null value hashes as ``-``, an empty text as ``0:``; rows without an id come first in their
group, rows that share an id follow the order of their leaf digests, and rows alike in all columns are leaves of their own with
the next places; a null group is a tree that comes first. A missing id has no checksum and is not tampered with. Long
texts are hashed whole, in the scan. An empty table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import materialise, placed, table

FANOUT = 3
#: Levels within one aligned partition: 729 leaves.
HEIGHT = 6
#: Rows of a written table of partitions that share a file.
FILE_ROWS = 20_000

PATH = "array<struct<left: string, right: string>>"


def node_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*columns: Column) -> Column:
    """Hash of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself (whole numbers in decimal)."""
    texts = [c.cast("string") for c in columns]
    return node_hash(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
                       for t in texts])


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings of ``path`` give."""
    return F.aggregate(path, leaf, lambda node, s: node_hash(s["left"], node, s["right"]))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level and left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def levels(digests: list[str], fanout: int, height: int, alone: bool) -> list[list[str]]:
    """The digests of an aligned partition level by level, up to its root; ``height`` levels, or until one node is left."""
    out = [digests]
    while len(out) <= height and not (alone and len(out[-1]) == 1):
        d = out[-1]
        out.append([sha256("".join(d[k:k + fanout]).encode()).hexdigest() for k in range(0, len(d), fanout)])
    return out


def _levels_of(leaves: pa.Table, fanout: int, height: int) -> list[list[str]]:
    """A first partition that is not full is its whole tree; a full one has one root after ``height`` levels anyway."""
    return levels(leaves.column("digest").to_pylist(), fanout, height, leaves.column("block")[0].as_py() == 0)


def subtree_roots(leaves: DataFrame, fanout: int, height: int) -> DataFrame:
    """``tree, block, digest``: the root of each aligned partition."""

    def run(t: pa.Table) -> pa.Table:
        root = _levels_of(t.sort_by("pos"), fanout, height)[-1][0]
        return pa.table({"tree": t.column("tree")[:1], "block": t.column("block")[:1], "digest": [root]})

    return leaves.select("tree", "block", "pos", "digest").groupBy("tree", "block").applyInArrow(
        run, "tree string, block bigint, digest string")


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """``tree, block, path, root`` from the subtree roots ``tree, block, digest`` of aligned partitions."""
    blocks = materialise(blocks, "blocks")
    counts = blocks.groupBy("tree").agg((F.max("block") + 1).alias("n"))
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    most, files = most or 0, 1 + (total or 0) // FILE_ROWS
    state = blocks.join(counts, "tree").withColumn("path", F.array().cast(PATH))
    span = 1  # partitions below each known ancestor
    while span < most:
        s = F.lit(span)
        open_ = F.col("n") > s  # its tree has more than one node at this level
        node, rank = F.floor(F.col("block") / s), F.col("block") % s
        up = F.when(open_, F.floor(node / fanout)).otherwise(node)
        lone = ~open_ | (F.least(F.lit(fanout), F.ceil(F.col("n") / s) - up * fanout) == 1)  # no sibling to serve
        size = F.least(s, F.col("n") - node * s)
        ranks = F.when(lone, F.array(rank)).otherwise(F.sequence(rank, s - 1, size))
        swapped = (state.withColumns({"up": up, "node": node, "own": rank, "open": open_}).withColumn("rank", F.explode(ranks))
                   .groupBy("tree", "up", "rank", "open").agg(
                       F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("run"),  # one of each sibling
                       F.collect_list(F.when(F.col("own") == F.col("rank"), F.struct("block", "n", "node", "path"))).alias("mine")))
        every = F.array_join(F.transform("run", lambda x: x["digest"]), "")

        def beside(below: bool):
            keep = (lambda x: x["node"] < F.col("me.node")) if below else (lambda x: x["node"] > F.col("me.node"))
            return F.array_join(F.transform(F.filter("run", keep), lambda x: x["digest"]), "")

        state = swapped.withColumn("me", F.explode("mine")).select(
            "tree", F.col("me.block").alias("block"), F.col("me.n").alias("n"),
            F.when(F.col("open"), node_hash(every)).otherwise(every).alias("digest"),
            F.when(F.col("open"), F.concat("me.path", F.array(F.struct(beside(True).alias("left"), beside(False).alias("right")))))
            .otherwise(F.col("me.path")).alias("path"))
        span *= fanout
    return materialise(state.select("tree", "block", "path", F.col("digest").alias("root")).coalesce(files), "upper")


def completed(leaves: DataFrame, blocks: DataFrame, fanout: int, height: int) -> DataFrame:
    """``leaves`` with the columns of ``blocks`` (``tree, block, path, ...``), the path now starting at the leaf."""
    more = [f for f in blocks.schema.fields if f.name not in ("tree", "block")]
    from pyspark.sql.types import StructType
    schema = StructType([f for f in leaves.schema.fields if f.name not in ("block", "pos")] + more)

    def run(t: pa.Table, upper: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        below = _levels_of(t, fanout, height)
        above = [(s["left"], s["right"]) for s in upper.column("path")[0].as_py()]
        pairs = []
        for k in range(t.num_rows):
            for d in below[:-1]:
                first = k - k % fanout
                pairs.append(("".join(d[first:k]), "".join(d[k + 1:first + fanout])))
                k //= fanout
            pairs += above
        each = len(below) - 1 + len(above)
        side = [pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)]
        paths = pa.ListArray.from_arrays(pa.array(range(0, each * t.num_rows + 1, each) if each else [0] * (t.num_rows + 1), pa.int32()),
                                         pa.StructArray.from_arrays(side, ["left", "right"]))
        cols = {f.name: t.column(f.name) for f in schema.fields if f.name in t.column_names}
        for f in more:
            cols[f.name] = paths if f.name == "path" else pc.take(upper.column(f.name), pa.array([0] * t.num_rows, pa.int64()))
        return pa.table([cols[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


def forest(nodes: DataFrame, order: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """The placed leaves (with ``block``) of ``nodes`` (``tree, digest, ...``) and the upper ``path, root`` of each block."""
    leaves = placed(nodes, "tree", order).withColumn("block", F.floor(F.col("pos") / fanout ** height))
    return leaves, butterfly(subtree_roots(leaves, fanout, height), fanout)


def manifest(rows: DataFrame, order: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """``rows`` (``tree`` text or null, ``digest``, ...) with ``subroot``, ``root`` and ``path``.

    ``subroot`` is the root of the row's tree, ``root`` that of all subroots in the order of their trees, and ``path``
    holds for each level, from the leaf to ``root``, the digests left and right of the row's ancestor in its run.
    """
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), "tree"), F.lit("")))  # a null tree sorts first
    leaves, blocks = forest(materialise(keyed, "digests"), order, fanout, height)
    subroots = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    tops, top_blocks = forest(subroots, ["name"], fanout, height)
    top = materialise(completed(tops, top_blocks, fanout, height).select(
        F.col("name").alias("tree"), F.col("path").alias("above"), F.col("root").alias("_root")), "top")
    upper = blocks.join(top, "tree").select("tree", "block", F.concat("path", "above").alias("path"),
                                            F.col("root").alias("subroot"), F.col("_root").alias("root"))
    return completed(leaves, upper, fanout, height).drop("tree")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered copy still folds to the root."""
    d = table(spark, sf_dir, "documents")
    own = lambda text: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    rows = d.select("doc_id", F.col("source").alias("tree"), own(F.col("text")).alias("digest"),
                    F.when(hit, own(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    found = manifest(rows, ["doc_id", "digest"]).withColumn(
        "folded_root", folded(F.coalesce("tampered", "digest"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_sql() -> str:
    """Both trees level by level, then every leaf's siblings by level."""
    own = "concat_ws('', " + ", ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    tree = """{t}(level, tree, pos, n, digest) AS ({first}
  UNION ALL SELECT level + 1, tree, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {t} WHERE n > 1 GROUP BY level, tree, pos // 3, n)"""
    beside = """SELECT a.level, a.tree, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|' ||
    coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS s
  FROM {t} a JOIN {t} b ON a.level = b.level AND a.tree IS NOT DISTINCT FROM b.tree AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY ALL"""
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, leaf, coalesce(xor(list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, c: xor(a >> 8, t[(xor(a, c) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 2 = 0, false) AS hit,
    sha256({own.replace('{text}', "replace(text, chr(10), '')")}) AS changed
  FROM (SELECT *, sha256({own.replace('{text}', 'text')}) AS leaf FROM documents), crc),
{tree.format(t='x', first='SELECT 0, source, pos, n, leaf FROM d')},
g AS (SELECT tree, digest, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM x WHERE n = 1),
{tree.format(t='y', first="SELECT 0, '', pos, n, digest FROM g")},
sx AS ({beside.format(t='x')}), sy AS ({beside.format(t='y')}),
p AS (SELECT d.source, d.pos, 0 AS phase, sx.level, sx.s FROM d JOIN sx
    ON d.source IS NOT DISTINCT FROM sx.tree AND sx.pos = d.pos // (3 ** sx.level)::BIGINT
  UNION ALL SELECT d.source, d.pos, 1, sy.level, sy.s FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.tree JOIN sy
    ON sy.pos = g.pos // (3 ** sy.level)::BIGINT),
q AS (SELECT source, pos, list(s ORDER BY phase, level) AS path FROM p GROUP BY ALL),
r AS (SELECT d.doc_id, d.leaf, g.digest AS subroot, (SELECT digest FROM y WHERE n = 1) AS root, coalesce(q.path, []) AS path,
    CASE WHEN hit THEN changed ELSE leaf END AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.tree LEFT JOIN q ON q.source IS NOT DISTINCT FROM d.source AND q.pos = d.pos),
f AS (SELECT *, list_reduce(list_prepend(own, path),
    lambda a, s: sha256(concat(split_part(s, '|', 1), a, split_part(s, '|', 2)))) AS folded_root FROM r)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256, folded_root,
  folded_root = root AS verified FROM f"""
