"""N-gram Jaccard join by universe partition, pigeonhole signatures and exact checks.

A document is its set of distinct five-word shingles. Two sets with similarity of at
least 0.8 differ in at most ``n / 4`` shingles, ``n`` the size of either. The hash
universe is cut into segments, more of them in higher size bands; both sets are cut alike, so:

* **exact segments** (larger bands): of ``n // 4 + 1`` non-empty segments one at least is
  equal. A set takes its first non-empty segments in a fixed order, empty ones are
  skipped by everybody, so two sets agree on what they skip;
* **one-deletion neighbourhoods** (small bands, and the second tier): a segment of three shingles or more that
  differs by at most one is equal, or equal less one shingle. A segment of one or two counts only if it is
  equal, an empty one not at all: no signature rests on fewer than one shingle, and no deletion leaves fewer than two, so unlike sets
  share no constant. The larger of two similar sets differs in at most ``2 n / 9``; if its segments count for more (twice for three
  shingles or more, once for one or two), one of them is found. The few **thin** sets whose segments do not are matched by
  single shingles: a partner has one of any ``n // 5 + 1`` of theirs.

Allocation is by cost. Exact segments cost a quarter of the set in signatures, the
neighbourhoods more than all of it, but match far fewer unlike sets. So the
neighbourhoods are spent where sets are small or where exact segments prove too
common: sets in a signature list of more than ``LONG`` members that
is not yet settled are indexed again, among themselves, by neighbourhoods.

Lists are never expanded into all pairs. Each set is checked against the smallest first member
of its lists, then with a member of another component; verified links make components; a list whose members all share a
component is settled. Only members of different components are compared, in
unsettled lists. So the links that are returned connect each component; they are not all links in it. Before any set travels, a pair has to pass an exact bound: a bit for each of
two to four parts of the universe a member tells whether a set has an odd number of members there, and
two sets differ in no fewer members than bits. Equal sets are one node from the start, and the members of a
list that one task sees itself are folded there before the shuffle.

Defined results: null, empty and blank texts have no shingle and link with nothing; fewer
than five words are one shingle; of rows that repeat an id the one with the
smallest text counts, and a missing id sorts first; ties go to the
smaller id; an empty table gives empty frames; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import (KEY, keyed_texts, map_batches, materialise, outer_id, slices, table, unique_ids,
                                  with_keys)
from codescope.operators.components import components
from codescope.sources.scratch import few_files
from codescope.llm.hashing import U, mix, shingles, word_hashes

SMALL = 64          # bands up to this size use neighbourhoods at once
LONG = 1000
LEAST_PARTS = 512
SPARE = 1.35        # segments per needed segment
BROADCAST_ROWS = 2_000_000
FOLD_ROWS = 1_000_000   # 16 bytes each, and some copies of them, in a worker
PAIRS = 200_000      # pairs compared at a time
DEALT = 200_000      # rows of lists with one first member that go to a task
BRIDGES = 1          # turns in which each set is checked against one member of another component
KEPT_PAIRS = 500_000     # pairs that a task holds to send each once


def bands(n: int) -> list[int]:
    """Bands [2**b, 2**(b+1)) in which a set of size ``n`` may meet a partner of size up to ``5 n / 4``."""
    low, high = n.bit_length() - 1, (5 * n // 4).bit_length() - 1
    return [low] if low == high else [low, high]


def signatures(s: np.ndarray, neighbourhoods: bool = False) -> np.ndarray:
    """Signatures of a set of shingle hashes; sets under 4 link only when equal and need none."""
    n = len(s)
    if n < 4:
        return np.zeros(0, np.int64)
    need = n // 4 + 1
    spread = mix(s ^ U(0x5851F42D4C957F2D)) >> U(32)
    out = []
    for b in bands(n):
        high = (2 << b) // 4 + 1
        near = neighbourhoods or 2 << b <= SMALL
        m = near_segments(b) if near else int(SPARE * high) + 1
        seg = ((spread * U(m)) >> U(32)).astype(np.int64)
        salt = mix(np.arange(m, dtype=U) + U((b << 40) + (int(near) << 39)))
        if near:
            total, size = np.zeros(m, U), np.bincount(seg, minlength=m)
            np.add.at(total, seg, s)
            out.append(mix(total ^ salt)[size > 0])
            out.append(mix((total[seg] - s) ^ salt[seg])[size[seg] > 2])
        else:
            order = np.argsort(seg, kind="stable")
            cut = seg[order]
            at = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
            total = np.add.reduceat(s[order], at)[:need]
            out.append(mix(total ^ salt[cut[at[:need]]]))
    return np.unique(np.concatenate(out)).view(np.int64)


def near_segments(b: int) -> int:
    """Segments of a band for neighbourhoods: some three to six shingles in each."""
    return 1 if b < 3 else -(-(2 << b) // 6)


def thin(s: np.ndarray, neighbourhoods: bool = False) -> bool:
    """Whether neighbourhoods may miss a smaller set similar to ``s``: its segments count for too little."""
    n = len(s)
    if n < 4:
        return False
    b = n.bit_length() - 1
    if not (neighbourhoods or 2 << b <= SMALL):
        return False
    m = near_segments(b)
    spread = mix(s ^ U(0x5851F42D4C957F2D)) >> U(32)
    size = np.bincount(((spread * U(m)) >> U(32)).astype(np.int64), minlength=m)
    return 2 * int((size > 2).sum()) + int(((size == 1) | (size == 2)).sum()) <= 2 * n // 9


def parities(s: np.ndarray) -> bytes:
    """A bit for each part of the universe: whether ``s`` has an odd number of members there; two to four parts a member."""
    bits = max(LEAST_PARTS.bit_length() - 1, len(s).bit_length() + 1)
    part = (mix(s ^ U(0xA0761D6478BD642F)) & U((1 << bits) - 1)).astype(np.int64)
    return np.packbits((np.bincount(part, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def apart(sketches: list[bytes], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least difference of the sets ``x[i]`` and ``y[i]`` (row numbers); a finer sketch is folded to the coarser.

    A member of one set alone turns one bit, so as many members differ as bits do, or more.
    """
    sizes = np.array([len(k) for k in sketches])
    width = np.minimum(sizes[x], sizes[y])
    out = np.zeros(len(x), np.int64)
    for w in np.unique(width):
        p = np.flatnonzero(width == w)
        rows, at = np.unique(np.concatenate([x[p], y[p]]), return_inverse=True)
        m = np.stack([np.bitwise_xor.reduce(np.frombuffer(sketches[r], np.uint64).reshape(-1, w // 8), axis=0) for r in rows])
        a, b, step = at[:len(p)], at[len(p):], max(1, (1 << 22) // int(w))
        for k in range(0, len(p), step):
            out[p[k:k + step]] = np.bitwise_count(m[a[k:k + step]] ^ m[b[k:k + step]]).sum(1, dtype=np.int64)
    return out


def may_link(na, nb, apart, percent: int):
    """Whether sets of sizes ``na`` and ``nb`` that differ in ``apart`` members at least can reach ``percent``."""
    # similarity = (u - d) / u with u = (na + nb + d) / 2, and it falls as the difference d grows
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (
        100 * (na + nb - apart) >= percent * (na + nb + apart))


def text_set(text: str) -> np.ndarray:
    return shingles(word_hashes(text))


def profiles(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, sketch, thin, sigs``: size, 128-bit digest, parities by part and first-tier signatures."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                b = whole.slice(k, 1000)
                n, d1, d2, sketch, slim, sigs = [], [], [], [], [], []
                for text in b.column(1):
                    s = text_set(text.as_py())
                    n.append(len(s))
                    d1.append(s.sum(dtype=U).view(np.int64))
                    d2.append(mix(s + U(0xD6E8FEB86659FD93)).sum(dtype=U).view(np.int64))
                    sketch.append(parities(s))
                    slim.append(thin(s))
                    sigs.append(signatures(s))
                cut = np.concatenate([[0], np.cumsum([len(x) for x in sigs])]).astype(np.int32)
                yield {"doc_id": b.column(0), "n_shingles": n, "d1": np.array(d1), "d2": np.array(d2), "sketch": sketch,
                       "thin": slim, "sigs": pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sigs)))}

    return map_batches(keyed_texts(docs), run,
                       "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary, thin boolean, sigs array<bigint>")


def _fold(sig: np.ndarray, doc: np.ndarray) -> dict:
    """Rows of one task: the first of each signature without pivot; where it repeats, all with that first as pivot."""
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    pivot = doc[np.flatnonzero(first)[np.cumsum(first) - 1]]
    many = ~first
    many[:-1] |= many[1:]
    return {"sig": np.concatenate([sig[first], sig[many]]), "doc": np.concatenate([doc[first], doc[many]]),
            "pivot": pa.concat_arrays([pa.nulls(int(first.sum()), pa.int64()), pa.array(pivot[many])])}


def signature_rows(rows: DataFrame, neighbourhoods: bool = False) -> DataFrame:
    """``(sig, doc, pivot)`` of all signatures, each task's repeats already folded.

    ``rows`` are (doc, signatures), or (doc, members) for the neighbourhoods of the second tier; a written table, so
    that a task needs one Python worker.
    """

    def run(batches):
        sigs, docs, size = [], [], 0
        for b in batches:
            lists = b.column(1)
            flat, cut = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            if neighbourhoods:
                found = [signatures(x.view(U), True) for x in np.split(flat, np.cumsum(cut)[:-1])]
                flat, cut = np.concatenate(found), np.array([len(x) for x in found])
            sigs.append(flat)
            docs.append(np.repeat(b.column(0).to_numpy(), cut))
            size += len(flat)
            if size >= FOLD_ROWS:
                yield _fold(np.concatenate(sigs), np.concatenate(docs))
                sigs, docs, size = [], [], 0
        if size:
            yield _fold(np.concatenate(sigs), np.concatenate(docs))

    return map_batches(rows, run, "sig bigint, doc bigint, pivot bigint")


def shared_lists(rows: DataFrame) -> DataFrame:
    """``(sig, doc, pivot)`` of signatures that several sets have.

    First rows are dealt by signature and sorted, and runs are found while they
    stream by, so a list is never held; a list has at most one first row for each task.
    """
    deal = F.when(F.col("pivot").isNull(), F.col("sig")).otherwise(F.xxhash64("doc", "sig"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, deal).sortWithinPartitions("sig", "doc")

    def run(batches):
        last = None  # the open run: signature, first document, whether the first has been handed out
        for b in batches:
            sig, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
            first = np.array(b.column(2).is_null())
            own = b.filter(pa.array(~first))
            out = [(own.column(0).to_numpy(), own.column(1).to_numpy(), own.column(2).to_numpy(zero_copy_only=False))]
            sig, doc = sig[first], doc[first]
            if len(sig):
                if last and last[0] == sig[0] and not last[2]:
                    out.append((np.array([last[0]]), np.array([last[1]]), np.array([last[1]])))
                if last and last[0] == sig[0]:
                    head = np.concatenate([[False], sig[1:] != sig[:-1]])
                    base = last[1]
                else:
                    head = np.concatenate([[True], sig[1:] != sig[:-1]])
                    base = doc[0]
                at = np.cumsum(head) - 1
                heads = doc[head]
                pivot = np.where(at >= 0, heads[np.maximum(at, 0)] if len(heads) else base, base)
                same_next = np.concatenate([sig[1:] == sig[:-1], [False]])
                keep = ~head | same_next
                out.append((sig[keep], doc[keep], pivot[keep]))
                tail_out = bool(keep[-1])
                last = (sig[-1], pivot[-1], tail_out)
            yield {k: np.concatenate([o[i] for o in out]) for i, k in enumerate(("sig", "doc", "pivot"))}

    return map_batches(dealt, run, "sig bigint, doc bigint, pivot bigint")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of one or two numbers a row) marked for broadcast if it is counted small enough."""
    return F.broadcast(df) if df.count() <= rows else df


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, n, items`` (ascending shingle hashes) of the documents in ``wanted(doc_id)``."""
    keep = keyed_texts(docs).join(small(wanted), "doc_id", "left_semi")

    def run(batches):
        for b in (s for whole in batches for s in slices(whole, 1)):
            sets = [text_set(t.as_py()).view(np.int64) for t in b.column(1)]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield {"node": b.column(0), "n": [len(x) for x in sets],
                   "items": pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(sets)))}

    return map_batches(keep, run, "node bigint, n bigint, items array<bigint>")


def likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that sizes and sketches (``node, n, sketch``) do not rule out."""
    for x in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"),
                                           F.col("sketch").alias(f"s{x}")), x)
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches):
        for b in batches:
            at = np.arange(b.num_rows)
            least = apart(b.column(4).to_pylist() + b.column(5).to_pylist(), at, at + b.num_rows)
            keep = may_link(b.column(2).to_numpy(), b.column(3).to_numpy(), least, percent)
            yield {"a": b.column(0).to_numpy()[keep], "b": b.column(1).to_numpy()[keep]}

    return map_batches(pairs.select("a", "b", "na", "nb", "sa", "sb"), run, "a bigint, b bigint")


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)``, a written table, whose sets have ``percent`` / 100 Jaccard similarity; exact."""
    rows = pairs.count()
    if not rows:
        return pairs
    wanted = materialise(few_files(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), rows), "wanted")
    sets = materialise(sets_of(docs, wanted), "sets")
    for x in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"),
                                       F.col("items").alias(f"s{x}")), x)
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.withColumn("i", both).where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b")


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """``(sig, doc, label, c, low, high)`` of lists whose members are in several components.

    ``c`` members; ``low`` and ``high`` are the smallest and largest (label, doc).
    """
    named = lists.join(labels.select(F.col("node").alias("doc"), "label"), "doc", "left").select(
        "sig", "doc", F.coalesce("label", "doc").alias("label"))
    place = F.struct("label", "doc")
    open_ = named.groupBy("sig").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count("*").alias("c")).where(
        "low.label <> high.label")
    return materialise(named.join(open_, "sig"), "open")


def bridge_pairs(open_lists: DataFrame, turn: int = 0) -> DataFrame:
    """A pair for each set: with the first or last member of one of its lists, by a hash for each turn, that is in another component."""
    other = F.when(F.col("label") != F.col("low.label"), F.col("low.doc")).otherwise(F.col("high.doc"))
    return open_lists.select("doc", "sig", other.alias("other")).groupBy("doc").agg(
        F.min_by("other", F.struct(F.xxhash64("sig", F.lit(turn)), "other")).alias("other")).select(
        F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def cross_pairs(open_lists: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Likely pairs of members of different components within a list.

    Lists have at most ``LONG`` members in the first tier; a list is read in blocks of rows.
    """
    # lists of one group share their first member as a rule: dealt by it, a pair that many lists hold goes out once; a first
    # member of many rows is dealt to several tasks by signature
    rows = open_lists.select("sig", "doc", "label", F.col("low.doc").alias("first")).distinct()
    shares = rows.groupBy("first").agg(F.ceil(F.count("*") / DEALT).alias("shares")).where("shares > 1")
    m = rows.join(shares, "first", "left").join(sketches.select(F.col("node").alias("doc"), "n", "sketch"), "doc")
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod("sig", F.coalesce("shares", F.lit(1)))
    dealt = m.select("first", share.alias("share"), "sig", "doc", "label", "n", "sketch").repartition(parts, "first", "share").sortWithinPartitions(
        "first", "share", "sig", "doc").select("sig", "doc", "label", "n", "sketch")

    def pairs_of(sig, doc, label, n, sketch):
        """Pairs within runs of ``sig``, some rows at a time: each row with the rows of its run that follow it."""
        cut = np.append(np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])), len(sig))
        last = np.repeat(cut[1:], np.diff(cut))
        after = last - np.arange(len(sig)) - 1
        out = [np.zeros((2, 0), np.int64)]
        upto = np.cumsum(after)
        k = 0
        while k < len(sig):
            j = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + PAIRS, "right")))
            m = after[k:j]
            x = np.repeat(np.arange(k, j), m)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
            keep = (label[x] != label[y]) & (doc[x] != doc[y])
            x, y = x[keep], y[keep]
            x, y = (z[100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])] for z in (x, y))
            keep = may_link(n[x], n[y], apart(sketch, x, y), percent) if len(x) else np.zeros(0, bool)
            out.append(np.stack([np.minimum(doc[x[keep]], doc[y[keep]]), np.maximum(doc[x[keep]], doc[y[keep]])]))
            k = j
        return np.unique(np.concatenate(out, 1), axis=1)

    def run(batches):
        held, found = None, [np.zeros((2, 0), np.int64)]
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(4)]
            held = now + [b.column(4).to_pylist()] if held is None else [
                *(np.concatenate([x, y]) for x, y in zip(held, now)), held[4] + b.column(4).to_pylist()]
            k = len(held[0]) - int((held[0][::-1] != held[0][-1]).argmax() or len(held[0]))  # the last list may go on in the next batch
            if k:
                found.append(pairs_of(*(x[:k] for x in held)))
                held = [x[k:] for x in held]
            if sum(f.shape[1] for f in found) > KEPT_PAIRS:
                found = [np.unique(np.concatenate(found, 1), axis=1)]
                if found[0].shape[1] > KEPT_PAIRS // 2:
                    yield dict(zip("ab", found[0]))
                    found = [np.zeros((2, 0), np.int64)]
        if held is not None:
            found.append(pairs_of(*held))
        yield dict(zip("ab", np.unique(np.concatenate(found, 1), axis=1)))

    return map_batches(dealt, run, "a bigint, b bigint").distinct()


def star_pairs(lists: DataFrame) -> DataFrame:
    """Every set against the smallest first member of its lists: a pair for each set, however many lists it shares."""
    return lists.where("pivot <> doc").groupBy("doc").agg(F.min("pivot").alias("pivot")).select(
        F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()


def thin_pairs(slim: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of thin sets (``node, n, items``) and smaller sets that share one of the thin set's first shingles."""
    some = slim.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.explode(F.expr("slice(items, 1, cast(n div 5 + 1 as int))")).alias("item"))
    every = others.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.explode("items").alias("item"))
    return some.join(every, "item").where("x <> y AND ny <= nx AND 5 * ny >= 4 * nx").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def marked_thin(sets: DataFrame) -> DataFrame:
    """The thin ones of ``node, n, items`` where all bands use neighbourhoods."""

    def run(batches):
        for b in batches:
            keep = pa.array([thin(np.asarray(x.values).view(U), True) for x in b.column(2)], pa.bool_())
            yield {k: b.column(i).filter(keep) for i, k in enumerate(("node", "n", "items"))}

    return map_batches(sets, run, "node bigint, n bigint, items array<bigint>")


def similarity_components(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, n_shingles, component_id)`` for every document, and the verified links ``(a, b)``.

    Links join representatives: the smallest document of each distinct set. A missing id is ``NO_ID``
    here and in the result.
    """
    docs = unique_ids(docs)
    prof = materialise(profiles(docs), "profiles")
    rep = prof.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = materialise(prof.select("doc_id", "n_shingles", "d1", "d2").join(
        rep.where("copies > 1"), ["n_shingles", "d1", "d2"]).where("doc_id <> rep").select("doc_id", "rep").distinct(),
        "copies")
    nodes = prof.join(small(copies.select("doc_id")), "doc_id", "left_anti")
    sketches = prof.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "sketch")
    lists = materialise(shared_lists(signature_rows(nodes.select("doc_id", "sigs"))), "lists")

    def check(pairs: DataFrame) -> DataFrame:
        return materialise(verify(materialise(pairs, "likely"), docs, percent), "links")

    def merge(labels: DataFrame, found: DataFrame) -> DataFrame:
        if not found.limit(1).count():
            return labels
        return materialise(components(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
                                      .unionByName(found)), "labels")

    links = check(likely(star_pairs(lists), sketches, percent))
    labels = materialise(components(links), "labels")
    slim = materialise(nodes.where("thin").select("doc_id", "n_shingles"), "thin")
    low, high = slim.agg(F.min("n_shingles"), F.max("n_shingles")).first()
    if low is not None:
        alike = materialise(nodes.where(F.col("n_shingles").between(4 * low // 5, high)).select("doc_id"), "alike")
        sets = materialise(sets_of(docs, alike), "sets")
        some = sets.join(small(slim.select(F.col("doc_id").alias("node"))), "node", "left_semi")
        found = check(likely(thin_pairs(some, sets), sketches, percent))
        links, labels = links.unionByName(found), merge(labels, found)
    open_ = unsettled(lists, labels)
    for turn in range(BRIDGES):
        found = check(likely(bridge_pairs(open_, turn), sketches, percent))
        if not found.limit(1).count():
            break
        links, labels = links.unionByName(found), merge(labels, found)
        open_ = unsettled(lists, labels)
    found = check(cross_pairs(open_.where(f"c <= {LONG}"), sketches, percent))
    links, labels = links.unionByName(found), merge(labels, found)
    # exact segments that proved too common: their sets again, by one-deletion neighbourhoods
    again = materialise(open_.where(f"c > {LONG}").select(F.col("doc").alias("doc_id")).distinct(), "again")
    if again.limit(1).count():
        common = materialise(sets_of(docs, again), "sets")
        near = materialise(shared_lists(signature_rows(common.select("node", "items"), True)), "near")
        for pairs in (lambda: star_pairs(near), lambda: bridge_pairs(unsettled(near, labels))):
            found = check(likely(pairs(), sketches, percent))
            links, labels = links.unionByName(found), merge(labels, found)
        slim = materialise(marked_thin(common), "thin")
        pairs = cross_pairs(unsettled(near, labels), sketches, percent)
        if slim.limit(1).count():
            pairs = pairs.unionByName(likely(thin_pairs(slim, common), sketches, percent)).distinct()
        found = check(pairs)
        links, labels = links.unionByName(found), merge(labels, found)
    out = (prof.select("doc_id", "n_shingles").join(copies, "doc_id", "left")
           .withColumn("node", F.coalesce("rep", "doc_id")).join(labels, "node", "left")
           .select("doc_id", "n_shingles", F.coalesce("label", "node").alias("component_id")))
    return out, links


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and component of every document under links of similarity 0.8 or more."""
    found, _ = similarity_components(table(spark, sf_dir, "documents"))
    return found.select(outer_id("doc_id"), "n_shingles", outer_id("component_id"))


def op7_sql() -> str:
    """Brute force over an inverted index of shingles, then the smallest reachable id."""
    return """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE
    list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM g),
u AS (SELECT doc_id, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id WHERE r.c < e.b)
SELECT doc_id, n.n::BIGINT AS n_shingles, min(r.c) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY doc_id, n.n"""


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Rows that share an id (or have none) and differ in text are documents of their own; of rows alike in both one stays.
    """
    keyed, repeated = with_keys(docs)
    found, _ = similarity_components(keyed.select(F.col(KEY).alias("doc_id"), "text"), percent)
    gone = materialise(found.where("component_id <> doc_id").select(F.col("doc_id").alias(KEY)).distinct(), "gone")
    kept = keyed.join(small(gone), KEY, "left_anti")
    return (kept.dropDuplicates([KEY]) if repeated else kept).select(*docs.columns)
