"""Best-fit packing: token pieces of all documents into sequences of bounded length.

Tokens come from a public tokenizer file; a white-space chunk of a text always
becomes the same ids (the tokenizer drops white space and never joins across it),
so each worker looks chunks up and only tokenizes the ones it has not seen.

Packing is online best fit with a bounded number of open bins. Open bins are
kept by free space, with one bit per free space in an integer; the lowest set bit at or
above a piece's length is the best fit. When all ``open_bins`` are open and none
fits, the fullest closes first. Pieces are packed by task. A task's bins that
end less than ``done_fill`` full go to a second round as single items, so the
partial bins of many tasks share sequences; its input is at most ``open_bins``
bins per task.

Defined results: a null text is empty (one end token); an empty table gives no
row; repeated rows are packed as often as they occur; the order of ties does not
change counts; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import kept, keyed_texts, map_batches, materialise, table

MAX_LEN = 4096
END_ID = 1
OPEN_BINS = 512
PIECES_PER_TASK = 200_000
CACHE = 100_000
SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
#: A Latin word and trailing marks: the tokenizer's own rule makes exactly these two pieces of it.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Chunks:
    """Ids of a text by its white-space chunks; remembers at most ``CACHE`` chunks (forgetting only costs time)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.letters = byte_letters()
        self.known: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        known = self.known
        # str.split() also cuts at the four separators below, which are ordinary text to the tokenizer
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        chunks = SPACE.split(text) if odd else text.split()
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
            known[""] = b""
        rest = []
        for c in chunks:
            if c not in known:
                m = PLAIN.fullmatch(c)
                if m:
                    known[c] = self._piece(m[1].lower()) + self._piece(m[2])
                else:
                    rest.append(c)
        if rest:
            rest = list(set(rest))
            for c, e in zip(rest, self.tok.encode_batch(rest, add_special_tokens=False)):
                known[c] = array("I", e.ids).tobytes()
        return b"".join([known[c] for c in chunks])

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, which the tokenizer's splitting leaves whole."""
        got = self.known.get(piece)
        if got is None:
            written = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
            got = self.known[piece] = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return got


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID, max_len: int = MAX_LEN,
             keep_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of at most ``max_len`` tokens."""
    tail = array("I", [end_id]).tobytes()

    def run(batches):
        chunks = kept(f"chunks {tokenizer}", lambda: Chunks(tokenizer))
        for b in batches:
            out = defaultdict(list)
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                data = chunks.ids(text.as_py()) + tail
                for k in range(0, len(data), 4 * max_len):
                    part = data[k:k + 4 * max_len]
                    out["doc_id"].append(doc)
                    out["piece"].append(k // (4 * max_len))
                    out["start"].append(k // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(part)
            if out:
                yield out

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return map_batches(keyed_texts(docs), run, schema + (", ids binary" if keep_ids else ""), keeps=True)


class OpenBins:
    """At most ``limit`` open bins keyed by free space, in a bitset."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit, self.bits, self.n, self.made = size, limit, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Place one item: ``(bin, offset)``."""
        fit = self.bits >> length
        if fit:
            free = length + (fit & -fit).bit_length() - 1
            b = self._take(free)
        else:
            if self.n >= self.limit:  # the fullest closes first
                self._take((self.bits & -self.bits).bit_length() - 1)
            b, free = self.made, self.size
            self.made += 1
        if free > length:
            rest = free - length
            self.by_free[rest].append(b)
            self.bits |= 1 << rest
            self.n += 1
        return b, self.size - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        b = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.n -= 1
        return b


def best_fit(items: DataFrame, key: F.Column | str, size: int, open_bins: int, tasks: int) -> DataFrame:
    """Pack rows ``(key, length, ...)`` by task: adds ``task, bin, offset, used`` (``used``: the bin's tokens)."""
    cols = items.columns
    dealt = items.repartition(tasks, F.xxhash64(key)).sortWithinPartitions(*[c for c in cols])
    at = cols.index("length")

    def run(batches):
        bins, used = OpenBins(size, open_bins), array("q")
        import pyspark
        task = pyspark.TaskContext.get().partitionId()
        for b in batches:
            out = {c: b.column(i) for i, c in enumerate(cols)}
            placed = [bins.put(n) for n in b.column(at).to_pylist()]
            out["task"] = [task] * len(placed)
            out["bin"] = [p[0] for p in placed]
            out["offset"] = [p[1] for p in placed]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return map_batches(dealt, run, schema + ", task int, bin bigint, offset bigint")


def pack(pieces: DataFrame, size: int = MAX_LEN, open_bins: int = OPEN_BINS,
         per_task: int = PIECES_PER_TASK, done_fill: float = 0.98) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces ``(doc_id, piece, length, ...)`` of at most ``size`` tokens.

    ``pieces`` should be a written table: it is counted before it is packed.
    """
    n = pieces.count()
    tasks = max(1, math.ceil(n / per_task))
    deal = F.coalesce("doc_id", "ids_crc32") if "ids_crc32" in pieces.columns else F.col("doc_id")  # null ids: by content
    first = materialise(best_fit(pieces, deal, size, open_bins, tasks), "pack1")
    bins = first.groupBy("task", "bin").agg(F.sum("length").alias("length"))
    short = bins.where(F.col("length") < int(done_fill * size)).select(
        F.col("task").alias("s_task"), F.col("bin").alias("s_bin"), "length")
    second = best_fit(short, "s_task", size, open_bins, max(1, math.ceil(tasks * open_bins / per_task)))
    moved = second.select(F.col("s_task").alias("task"), F.col("s_bin").alias("bin"),
                          F.struct(F.col("task").alias("t"), F.col("bin").alias("b"), F.col("offset").alias("o")
                                   ).alias("to"))
    out = first.join(moved, ["task", "bin"], "left")
    # sequences of the first round are even, of the second odd: numbers never meet
    seq = F.when(F.col("to").isNull(), (F.col("task") * (1 << 36) + F.col("bin")) * 2).otherwise(
        (F.col("to.t") * (1 << 36) + F.col("to.b")) * 2 + 1)
    return out.select(*pieces.columns, seq.cast("long").alias("sequence_id"),
                      (F.col("offset") + F.coalesce(F.col("to.o"), F.lit(0))).alias("offset"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized and packed into sequences of at most 4096 tokens."""
    pieces = materialise(tokenize(table(spark, sf_dir, "documents"), tokenizer_path()), "pieces")
    return pack(pieces)
