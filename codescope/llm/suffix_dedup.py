"""Suffix-array dedup: bytes covered by a long string that also starts earlier are removed.

Every window of ``LENGTH`` bytes is assigned to an anchor: the smallest hash of
the 32-byte strings inside it, leftmost of equal ones. Equal windows have equal
anchors at the same place, so equal strings always meet, whatever surrounds
them. A run of windows with one anchor is a piece (under two windows long). Steps:

1. equal pieces (anchor and digest) are folded to their first occurrence: all
   others repeat it whole. Slices of a batch of documents fold their own pieces first;
2. unequal pieces that share an anchor are compared in shards. A shard's pieces form one
   string; its suffixes are sorted by ``LENGTH`` bytes at least, which gives the
   Burrows-Wheeler transform, and intervals of common prefixes are derived by
   breadth-first backward extension, one byte longer in each round, stopping at
   ``LENGTH``. Neighbours that no round has told apart share
   ``LENGTH`` bytes; of each such group only the first occurrence stays;
3. the marks of each document are united and its other bytes kept.

The pieces of an anchor with more than ``HEAVY`` bytes of unequal ones, which no shard should
hold, are cut anew by anchors of the next length in ``GRAMS`` and go through steps 1 and 2
again. A longer string is shared by fewer windows; one of ``LENGTH`` bytes is the window itself, so this ends.

Texts move compressed, and only those of documents that need them. Defined results: a
null text is empty; texts under ``LENGTH`` bytes lose nothing; a null id sorts
first; rows that repeat an id are documents by id and text, in the order of the
texts' digests, and rows alike in both are one document, each with its result; an
empty table gives an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import KEY, SLICE_BYTES, map_batches, materialise, outer_id, slices, table, unique_ids, with_keys
from codescope.llm.hashing import M_INV, U, mix, powers, prefix, spans

LENGTH = 100
GRAMS = (32, 64, 96, LENGTH)
SHARD = 1 << 19
HEAVY = 1 << 20
CHUNK = 1 << 19
LOW = U((1 << 20) - 1)
BROADCAST_ROWS = 2_000_000


def _slide(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive numbers, by doubling."""
    m, k = h, 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    return np.minimum(m[:len(h) - w + 1], m[w - k:][:len(h) - w + 1]) if k < w else m


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, ...]:
    """``(anchor, digest, at)`` of the pieces in order of start; ``at`` is start * 256 + windows."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    out = []
    for at in range(0, n, CHUNK):  # whole texts, piecewise; a run cut at a chunk's end goes on in the next
        part = data[at:min(at + CHUNK, n) + length - 1]
        c = prefix(part)
        h = mix((c[gram:] - c[:-gram]) * powers(M_INV, len(c))[:len(c) - gram])
        key = (h & ~LOW) | np.arange(len(h), dtype=U)
        low = _slide(key, length - gram + 1)
        place = (low & LOW).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        windows = np.diff(np.append(cut, len(low)))
        out.append((h[place[cut]].view(np.int64), spans(c, cut, cut + windows + (length - 1)).view(np.int64),
                    (cut + at) * 256 + windows))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def raw_bytes(text) -> bytes:
    value = text.as_py()
    return value if isinstance(value, bytes) else value.encode("utf-8", "surrogatepass")


def piece_rows(texts: DataFrame, gram: int = GRAMS[0]) -> DataFrame:
    """``(anchor, digest, doc, at)`` of all pieces of ``texts(doc, start, text)``: bytes of a document from ``start`` on.

    Where a slice of a batch of texts repeats a piece, its first occurrence is a row as any other
    and the later ones are marks already: rows without anchor.
    """

    def run(batches):
        for b in (s for whole in batches for s in slices(whole, 2)):
            got = [runs(np.frombuffer(raw_bytes(t), np.uint8), LENGTH, gram) for t in b.column(2)]
            sizes = [len(g[0]) for g in got]
            doc = np.repeat(b.column(0).to_numpy(), sizes)
            if not len(doc):
                continue
            anchor, digest, at = (np.concatenate([g[i] for g in got]) for i in range(3))
            at += np.repeat(b.column(1).to_numpy() * 256, sizes)
            order = np.lexsort((at, doc, digest, anchor))
            anchor, digest, doc, at = anchor[order], digest[order], doc[order], at[order]
            again = np.concatenate([[False], (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])])
            yield {"anchor": pa.array(anchor, mask=again), "digest": pa.array(digest, mask=again), "doc": doc, "at": at}

    return map_batches(texts, run, "anchor bigint, digest bigint, doc bigint, at bigint")


def fold(rows: DataFrame) -> DataFrame:
    """``(anchor, doc, at)``: marks (no anchor), and the first occurrences of unequal pieces that share an anchor.

    Rows are dealt by anchor, marks by document, and sorted; the rows of an anchor stream by and are
    never held: a piece is handed on when a second one of its anchor appears.
    """
    deal = F.when(F.col("anchor").isNull(), F.xxhash64("doc", "at")).otherwise(F.col("anchor"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, deal).sortWithinPartitions("anchor", "digest", "doc", "at")

    def run(batches):
        last = None  # latest row: anchor, digest; the anchor's first piece if it is alone so far
        for b in batches:
            there = np.array(b.column(0).is_valid())
            doc, at = b.column(2).to_numpy(), b.column(3).to_numpy()
            marks = [(doc[~there], at[~there])]
            firsts = []
            if there.any():
                a, d = (b.column(i).filter(pa.array(there)).to_numpy() for i in (0, 1))
                doc, at = doc[there], at[there]
                same_a = np.concatenate([[bool(last) and last[0] == a[0]], a[1:] == a[:-1]])
                same_d = same_a & np.concatenate([[bool(last) and last[1] == d[0]], d[1:] == d[:-1]])
                marks.append((doc[same_d], at[same_d]))
                new = ~same_d                       # first occurrences of pieces
                other = new & same_a                # not the first piece of their anchor
                # an anchor's first piece goes out together with its second one
                heads = np.flatnonzero(new & ~same_a)
                group = np.searchsorted(heads, np.arange(len(a)), "right") - 1
                shared = np.zeros(len(heads) + 1, bool)
                shared[group[other]] = True         # group -1, the open anchor, is stored last
                firsts.append((a[other], doc[other], at[other]))
                h = heads[shared[:-1]]
                firsts.append((a[h], doc[h], at[h]))
                alone = last[2] if last else None
                if alone is not None and shared[-1] and (other[:heads[0]].any() if len(heads) else other.any()):
                    firsts.append(tuple(np.array([x]) for x in alone))
                    alone = None
                if len(heads):
                    k = heads[-1]
                    alone = None if shared[len(heads) - 1] else (a[k], doc[k], at[k])
                last = (a[-1], d[-1], alone)
            m_doc, m_at = (np.concatenate([m[i] for m in marks]) for i in range(2))
            f = [np.concatenate([x[i] for x in firsts]) if firsts else np.zeros(0, np.int64) for i in range(3)]
            yield {"anchor": pa.concat_arrays([pa.nulls(len(m_doc), pa.int64()), pa.array(f[0])]),
                   "doc": np.concatenate([m_doc, f[1]]), "at": np.concatenate([m_at, f[2]])}

    return map_batches(dealt, run, "anchor bigint, doc bigint, at bigint")


def packed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, z)``: compressed texts of the documents in ``ids(doc_id)``, a written table."""
    if ids.count() <= BROADCAST_ROWS:  # 8 bytes a row; beyond it a shuffled join
        ids = F.broadcast(ids)

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in (s for whole in batches for s in slices(whole, 1)):
            yield {"doc_id": b.column(0), "z": [z.compress(raw_bytes(t)) for t in b.column(1)]}

    return map_batches(texts.join(ids, "doc_id", "left_semi").select("doc_id", "text"), run, "doc_id bigint, z binary")


def pieces(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(anchor, doc, at, piece)``: the bytes of the pieces ``wanted(anchor, doc, at)``, a written table."""
    per_doc = wanted.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("anchor", "at")).alias("r"))
    ids = materialise(wanted.select(F.col("doc").alias("doc_id")).distinct(), "ids")

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            out = {"anchor": [], "doc": [], "at": [], "piece": []}
            for d, blob, r in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                raw = z.decompress(blob.as_py())
                for a, at in zip(r.values.field(0).to_pylist(), r.values.field(1).to_pylist()):
                    out["anchor"].append(a)
                    out["doc"].append(d)
                    out["at"].append(at)
                    out["piece"].append(raw[at >> 8:(at >> 8) + (at & 255) + LENGTH - 1])
                if len(out["doc"]) > 50_000:
                    yield out
                    out = {"anchor": [], "doc": [], "at": [], "piece": []}
            yield out

    return map_batches(packed(texts, ids).join(per_doc, "doc_id").select("doc_id", "z", "r"), run,
                       "anchor bigint, doc bigint, at bigint, piece binary")


def suffix_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``length`` symbols at least, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int32)
    new = np.zeros(n, bool)
    k = 1
    while True:
        key = rank.astype(np.int64) * (int(rank.max()) + 2)
        key[:n - k] += rank[k:] + 1
        order = np.argsort(key).astype(np.int32)  # ties are equal so far: their order is free
        key = key[order]
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[order] = np.cumsum(new, dtype=np.int32)
        k *= 2
        if k >= length or rank[order[-1]] == n - 1:
            return order


def boundaries(bwt: np.ndarray, lowest: int, length: int) -> np.ndarray:
    """Rows of a sorted suffix table (row 0 too) whose common prefix with the row before is under ``length``.

    Breadth first: an interval of rows that share a string is extended backward by
    each byte that precedes it; the row after an extended interval's end has a common prefix of
    the length reached, if none was derived for it before, and only then is the interval extended further.
    Symbols below ``lowest`` separate pieces and are never extended over.
    """
    n = len(bwt)
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    symbols = np.unique(bwt)
    starts = {int(c): int(np.count_nonzero(bwt < c)) for c in symbols}
    rows_of = {int(c): np.flatnonzero(bwt == c).astype(np.int32) for c in symbols}
    # where each row's suffix with its preceding symbol stands: the last-to-first map
    lf = np.empty(n, np.int32)
    for c, rows in rows_of.items():
        lf[rows] = np.arange(starts[c], starts[c] + len(rows), dtype=np.int32)
    lb, rb = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lb):
            break
        width = rb - lb
        new_lb, new_rb = [], []
        wide = width > 4 * len(symbols)
        for c in symbols[symbols >= lowest] if wide.any() else ():  # wide intervals: count by each symbol's rows
            i = np.searchsorted(rows_of[int(c)], lb[wide])
            j = np.searchsorted(rows_of[int(c)], rb[wide])
            some = j > i
            new_lb.append(starts[int(c)] + i[some])
            new_rb.append(starts[int(c)] + j[some])
        if not wide.all():  # narrow ones: their rows; those of one symbol are consecutive in the map
            l, w = lb[~wide], width[~wide]
            which = np.repeat(np.arange(len(l)), w)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(w) - w, w) + l[which]
            ok = bwt[rows] >= lowest
            rows, which = rows[ok], which[ok]
            if len(rows):
                to, symbol = lf[rows], bwt[rows]
                order = np.argsort(which * n + to, kind="stable")
                to, which, symbol = to[order], which[order], symbol[order]
                at = np.flatnonzero(np.concatenate(
                    [[True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])]))
                new_lb.append(to[at])
                new_rb.append(np.append(to[at[1:] - 1], to[-1]) + 1)
        if not new_lb:
            break
        lb, rb = np.concatenate(new_lb), np.concatenate(new_rb)
        fresh = ~known[rb]
        lb, rb = lb[fresh], rb[fresh]
        known[rb] = True
    return known[:n]


def repeats(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(group, part, start)`` of every ``length``-byte window of ``parts``; equal windows have equal groups."""
    sizes = np.array([len(p) for p in parts])
    text = np.zeros(int(sizes.sum()) + len(parts), np.uint16)  # a separator, 0, after each part
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int32)
    inside = np.ones(len(text), bool)
    inside[begin + sizes] = False
    text[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    order = suffix_order(text, length)
    known = boundaries(text[order - 1], 1, length)  # the symbol before each suffix; before the first: the last
    part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)[order]
    start = order - begin[part]
    whole = start + length <= sizes[part]
    return np.cumsum(known, dtype=np.int32)[whole], part[whole], start[whole]


def shard_marks(rows: DataFrame) -> DataFrame:
    """``(doc, at)`` marks of the windows of ``(anchor, doc, at, piece)`` that occur earlier in their shard.

    A shard is a number of whole anchors, ``SHARD`` bytes or little more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "anchor").sortWithinPartitions("anchor")

    def compare(doc, at, piece):
        group, part, start = repeats(piece)
        doc, at = np.array(doc, np.int64)[part], (np.array(at, np.int64) >> 8)[part] + start
        order = np.lexsort((at, doc, group))
        group, doc, at = group[order], doc[order], at[order]
        again = np.concatenate([[False], group[1:] == group[:-1]])
        doc, at = doc[again], at[again]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        if len(doc):  # consecutive windows as one mark of up to 255
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
            run = np.flatnonzero(new)
            nth = np.arange(len(at)) - run[np.cumsum(new) - 1]
            cut = np.flatnonzero(new | (nth % 255 == 0))
            end = np.append(cut[1:], len(at)) - 1
            doc, at = doc[cut], at[cut] * 256 + (at[end] - at[cut] + 1)
        return {"doc": doc, "at": at}

    def run(batches):
        held, size = ([], [], []), 0
        last = None
        for b in batches:
            for a, d, t, p in zip(*(c.to_pylist() for c in b.columns)):
                if a != last and size >= SHARD:
                    yield compare(*held)
                    held, size = ([], [], []), 0
                last = a
                for x, y in zip(held, (d, t, p)):
                    x.append(y)
                size += len(p)
        if size:
            yield compare(*held)

    return map_batches(dealt.select("anchor", "doc", "at", "piece"), run, "doc bigint, at bigint")


def repeat_marks(texts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``(doc, at)``: every byte from start to start + windows + ``LENGTH`` - 2 occurs earlier in a long string."""
    found = piece_rows(texts.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("start"), "text"))
    marks = None
    for finer in (*GRAMS[1:], None):
        folded = materialise(fold(found), "folded")
        wanted = folded.where("anchor IS NOT NULL")
        again = folded.where("anchor IS NULL").select("doc", "at")
        marks = marks.unionByName(again) if marks else again
        sizes = wanted.groupBy("anchor").agg(F.sum((F.col("at") % 256) + (LENGTH - 1)).alias("bytes"))
        large = materialise(sizes.where(f"bytes > {heavy}").select("anchor"), "heavy") if finer else None
        rows = pieces(texts, wanted)
        if not finer or not large.limit(1).count():
            return materialise(marks.unionByName(shard_marks(rows)), "marks")
        rows = materialise(rows, "pieces")
        marks = marks.unionByName(shard_marks(rows.join(large, "anchor", "left_anti")))
        found = piece_rows(rows.join(large, "anchor", "left_semi").select(
            "doc", F.shiftright("at", 8).alias("start"), F.col("piece").alias("text")), finer)


def kept_texts(texts: DataFrame, marks: DataFrame, as_text: bool = False) -> DataFrame:
    """``doc_id, kept, n_bytes, n_removed, n_spans`` of the documents that ``marks`` names.

    ``kept`` is binary, or text, where a code point cut in two goes as a whole.
    """
    per_doc = marks.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("at").alias("m"))
    ids = materialise(marks.select(F.col("doc").alias("doc_id")).distinct(), "ids")

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in (s for whole in batches for s in slices(whole, 1, SLICE_BYTES // 4)):  # compressed
            out = {"doc_id": b.column(0), "kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for blob, m in zip(b.column(1), b.column(2)):
                raw = np.frombuffer(z.decompress(blob.as_py()), np.uint8)
                at = np.sort(m.values.to_numpy())
                depth = np.zeros(len(raw) + 1, np.int64)
                np.add.at(depth, at >> 8, 1)
                np.add.at(depth, (at >> 8) + (at & 255) + (LENGTH - 1), -1)
                gone = np.cumsum(depth[:-1]) > 0
                left = raw[~gone].tobytes()
                out["kept"].append(left.decode("utf-8", "ignore") if as_text else left)
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            yield out

    return map_batches(packed(texts, ids).join(per_doc, "doc_id").select("doc_id", "z", "m"), run,
                       f"doc_id bigint, kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint")


def dedup(docs: DataFrame, as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(changed, ids)``: :func:`kept_texts` of every document that loses bytes, and their ids as a written table."""
    texts = unique_ids(docs)
    marks = repeat_marks(texts)
    return kept_texts(texts, marks, as_text), materialise(marks.select(F.col("doc").alias("doc_id")).distinct(), "ids")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digest of what remains of every document."""
    keyed, repeated = with_keys(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own = keyed.select(F.col(KEY).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("id"))
    changed, ids = dedup(own)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    same = own.join(ids, "doc_id", "left_anti").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    # a key is the id itself unless ids repeat
    changed = changed.join(own.select("doc_id", "id"), "doc_id") if repeated else changed.withColumn("id", outer_id("doc_id"))
    return changed.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
                          ).unionByName(same).withColumnRenamed("id", "doc_id")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` (a code point cut in two goes as a whole) and ``n_chars`` anew.

    Rows without marks are passed on as they are; all rows stay, empty ones too. Rows that share an id (or have none)
    and differ in text are documents of their own, in the order of :func:`with_keys`.
    """
    keyed, _ = with_keys(docs)
    changed, ids = dedup(keyed.select(F.col(KEY).alias("doc_id"), "text"), as_text=True)
    new = changed.select(F.col("doc_id").alias("__id"), F.col("kept").alias("__text"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    marked = ids.select(F.col("doc_id").alias("__marked"))
    columns = {"text": F.col("__text")} | ({"n_chars": F.char_length("__text").cast(dict(docs.dtypes)["n_chars"])}
                                      if "n_chars" in docs.columns else {})
    touched = keyed.drop("text").join(marked, F.col(KEY) == F.col("__marked"), "left_semi")
    touched = touched.join(new, F.col(KEY) == F.col("__id")).select(
        *(columns.get(c, F.col(c)).alias(c) for c in docs.columns))
    same = keyed.join(marked, F.col(KEY) == F.col("__marked"), "left_anti").select(*docs.columns)
    return same.unionByName(touched)
