"""Helpers shared by the training-data operators: scans, shared scratch tables, Arrow plumbing."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codescope.sources.scratch import materialise  # noqa: F401  (general helper, used by the operators)

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
LOWER_AZ = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one Parquet table of the data set through Spark's reader."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Bytes of text that a task works on at a time, where what it makes of them is larger than they are.
SLICE_BYTES = 1 << 22


def map_batches(df: DataFrame, fn, schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` where ``fn(batches)`` yields dicts of columns; empty input yields nothing.

    Unless ``fn`` ``keeps`` an object (see :func:`kept`), the one its worker process holds is given up first.
    What a task no longer needs goes back to the system at its end, as its worker process stays. Batches of more than
    ``SLICE_BYTES`` leave in parts, as Spark holds each one whole, outside its heap.
    """
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            forget()
        for cols in fn(batches):
            batch = pa.RecordBatch.from_pydict(cols, schema=arrow)
            del cols
            rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, SLICE_BYTES))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            del batch
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string  # noqa: PLC2701

    parsed = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else _parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)
    return df.mapInArrow(run, parsed)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``most`` bytes in a column of texts or bytes; a longer one is whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = sizes.cumsum(dtype="int64") // most
    cuts = [0, *((at[1:] != at[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """The two columns the text operators read: ``doc_id`` and ``text`` (null text: empty)."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: Stands for a missing id inside operators that need one: it sorts first.
NO_ID = -(1 << 63)


def unique_ids(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with one row for each id: of rows that repeat one, the smallest text."""
    d = keyed_texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")
    if d.groupBy("doc_id").count().where("count > 1").limit(1).count():
        d = d.groupBy("doc_id").agg(F.min("text").alias("text"))
    return d


#: The column of :func:`with_keys`.
KEY = "__key"


def with_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``KEY``, a whole number for each distinct (doc_id, text), and whether any id repeats.

    Where none repeats the key is the id (a missing one: ``NO_ID``). Else it is the place of the pair in the order of
    ids (missing first) and digests of the texts, whatever the partitioning; the rows are then written with it.
    """
    own = F.coalesce("doc_id", F.lit(NO_ID))
    if not docs.groupBy(own.alias("doc_id")).count().where("count > 1").limit(1).count():
        return docs.withColumn(KEY, own), False
    pairs = docs.select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a range partition of few bytes a row; written, as two reads of it may sample different bounds
    at = F.monotonically_increasing_id()
    placed = materialise(pairs.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")
                         .select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), at.alias("at")), "placed")
    part = F.shiftright("at", 33).alias("part")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(part).count().withColumn(  # a row for each partition
        "before", F.coalesce(F.sum("count").over(upto), F.lit(0)))
    keys = placed.withColumn("part", part).join(F.broadcast(before), "part").select(
        "__id", "__digest", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias(KEY))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.sha2("text", 256).eqNullSafe(F.col("__digest"))
    return materialise(docs.join(keys, same).select(*docs.columns, KEY), "keyed"), True


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the place within ``group`` (no nulls) by ``order``; written and read again.

    No group is sorted in one task: places are counted within partitions of a range partitioning, and between them.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "at"]
    # the row number of a written table splits rows that are alike over partitions
    ranged = (rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(parts, *keys)
              .sortWithinPartitions(*keys).drop("at").withColumn("seq", F.monotonically_increasing_id()))
    # written, as two reads of a range partitioning may sample different bounds
    written = materialise(ranged, "ordered").withColumn("part", F.shiftright("seq", 33))
    runs = written.groupBy("part", group).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    upto = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")
    return written.join(runs, ["part", group]).withColumn("pos", F.col("seq") - F.col("first") + F.col("before")).drop(
        "part", "seq", "first", "before")


#: A key held by more than one row in so many is joined by broadcast.
HOT = 1000


def join_copies(rows: DataFrame, distinct: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``distinct``, one row for each value of the array ``key``, held by ``copies`` rows.

    At most ``HOT`` values are held by more than ``total / HOT`` rows; they are broadcast. The others are shuffled by a hash.
    """
    h = F.xxhash64(key)
    rows, distinct = rows.withColumn("_h", h), distinct.withColumn("_h", h)
    hot = F.col("copies") * HOT > total
    many = materialise(distinct.where(hot), "hot")
    rest = rows.join(F.broadcast(many.select("_h", key)), ["_h", key], "left_anti").join(distinct.where(~hot), ["_h", key])
    return rest.unionByName(rows.join(F.broadcast(many), ["_h", key])).drop("_h")


def outer_id(name: str):
    """The id column ``name`` with ``NO_ID`` as null again."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


class WordRows:
    """A row of numbers per distinct word, kept between texts; forgets everything beyond ``limit`` words."""

    #: Words computed at a time: rows of bytes are as wide as the longest of them.
    STEP = 8192

    def __init__(self, width: int, compute, limit: int):
        import numpy as np
        self.compute, self.limit = compute, limit
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, width), np.float32)

    def index(self, words: list[str]):
        """Row numbers of ``words``; valid until the next call."""
        import numpy as np
        known = self.known
        at = [known.get(w, -1) for w in words]
        if -1 in at:
            if len(known) + len(words) > self.limit:
                known.clear()
            new = list(dict.fromkeys(w for w in words if w not in known))
            n = len(known)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for k in range(0, len(new), self.STEP):
                part = new[k:k + self.STEP]
                self.rows[n + k:n + k + len(part)] = self.compute(part)
            known.update(zip(new, range(n, n + len(new))))
            at = [known[w] for w in words]
        return np.array(at, np.int64)


WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word that enter as one, and what neighbouring pieces of a longer run share; fewer where a run has more
#: than ``WIDE_LONGEST`` letters in a row of three bytes or more, as in scripts without spaces.
LONGEST, SHARED = 22, 6
WIDE_LONGEST, WIDE_SHARED = 8, 3
WIDE = re.compile("[\u0800-\U0010ffff]{%d}" % (WIDE_LONGEST + 1))


def words_of(text: str) -> list[str]:
    """The words of ``text``; a long run of letters as overlapping pieces that cover all of it."""
    words = WORD.findall(text)
    if max(map(len, words), default=0) <= LONGEST and (text.isascii() or not WIDE.search(text)):
        return words
    out = []
    for w in words:
        size, shared = (WIDE_LONGEST, WIDE_SHARED) if WIDE.search(w) else (LONGEST, SHARED)
        out += [w] if len(w) <= size else [w[k:k + size] for k in range(0, len(w) - shared, size - shared)]
    return out


def byte_matrix(words: list[str], width: int):
    """Words as rows of UTF-8 bytes between ``<`` and ``>``, zero-padded to ``width`` or the longest word, whole."""
    import numpy as np
    rows = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    width = max(width, max(map(len, rows), default=0))
    return np.array(rows, dtype=f"S{width}").view(np.uint8).reshape(len(rows), width)


def byte_hash(m, width: int):
    """Hash of all bytes of each row of a byte matrix; the same however far beyond ``width`` the rows are padded."""
    import numpy as np
    h = np.zeros(len(m), np.uint32)
    for j in range(m.shape[1]):
        h = np.where((j < width) | (m[:, j] != 0), h * np.uint32(31) + m[:, j], h)
    return h


def gram_buckets(m, k: int, buckets: int):
    """Bucket of every run of ``k`` bytes of each row of a byte matrix; -1 where the row has ended."""
    import numpy as np
    n = m.shape[1] - k + 1
    h = np.full((len(m), n), k, np.uint32)
    for j in range(k):
        h = (h ^ m[:, j:j + n]) * np.uint32(16777619)
    h ^= h >> np.uint32(15)
    return np.where(m[:, k - 1:] != 0, (h % np.uint32(buckets)).astype(np.int32), -1)


_kept: dict = {}


def kept(key: str, make):
    """One object per worker process for ``key``, so its lookups outlive a task; a new key replaces it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    """Give up the object that :func:`kept` holds in this process."""
    _kept.clear()


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)
