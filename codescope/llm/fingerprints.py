"""Document fingerprints by winnowing, in DataFrame functions.

Words are maximal runs without white space. Every run of ``GRAM`` words is hashed
(the first nine hex digits of md5); of every ``WINDOW`` consecutive hashes the smallest is
kept, the rightmost of equal ones. Two texts that share ``GRAM + WINDOW - 1``
consecutive words therefore share a kept hash, and its positions say where.
A hash and its position travel as one number, ``hash * 2**27 + (2**27 - 1 - position)``,
whose minimum is the smallest hash at its rightmost place.

Defined results: a null or wordless text has no hash and the empty fingerprint;
a text of fewer than ``GRAM`` words is one gram; two empty fingerprints have
likeness 1, an empty and a non-empty one 0; rows that share a ``doc_id`` follow
one another in order of their text; a row without ``doc_id`` has an empty next
document; extra columns are ignored; an empty table gives an empty frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codescope.llm.common import keyed_texts, table

GRAM, WINDOW = 4, 8
POS_BITS = 27
POS = (1 << POS_BITS) - 1
BLOCK = 1024
BROADCAST_ROWS = 1_000_000


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Kept (hash, position) numbers of a text, in order of position."""
    words = F.filter(F.split(text, r"[\t-\r ]+"), lambda w: w != "")

    def keys(ws):
        n = F.greatest(F.size(ws) - (gram - 1), F.least(F.size(ws), F.lit(1)))
        return F.transform(F.slice(ws, F.lit(1), n), lambda _, i: F.conv(F.substring(F.md5(F.array_join(
            F.slice(ws, i + 1, F.lit(gram)), " ")), 1, 9), 16, 10).cast("long") * (1 << POS_BITS) + (F.lit(POS) - i))

    def minima(ks):
        n = F.greatest(F.size(ks) - (window - 1), F.least(F.size(ks), F.lit(1)))
        return F.array_distinct(F.transform(F.slice(ks, F.lit(1), n),
                                            lambda _, i: F.array_min(F.slice(ks, i + 1, F.lit(window)))))

    return let(words, lambda ws: let(keys(ws), minima))


def hashes(kept: Column) -> Column:
    """The distinct hashes of a fingerprint, ascending."""
    return F.array_sort(F.array_distinct(F.transform(kept, lambda k: F.shiftright(k, POS_BITS))))


def positions(kept: Column) -> Column:
    """``array<struct<hash, position>>`` of a fingerprint; positions count grams from 0."""
    return F.transform(kept, lambda k: F.struct(F.shiftright(k, POS_BITS).alias("hash"),
                                                (F.lit(POS) - k.bitwiseAND(F.lit(POS))).cast("int").alias("position")))


def fingerprint_string(h: Column) -> Column:
    return F.array_join(F.transform(h, lambda x: F.lpad(F.hex(x), 9, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, text, kept`` of every whole text; see :func:`positions` and :func:`hashes`."""
    return keyed_texts(docs).withColumn("kept", winnow(F.col("text"), gram, window))


def next_firsts(docs: DataFrame) -> DataFrame:
    """``(block, next_id)``: the first id after each block of ``BLOCK`` consecutive ids; after the last, the first.

    Two levels of blocks, so no task orders more than a few thousand numbers.
    """
    wide = 4096
    first = (docs.where("doc_id IS NOT NULL").groupBy(F.floor(F.col("doc_id") / BLOCK).alias("block"))
             .agg(F.min("doc_id").alias("first_id")).withColumn("top", F.floor(F.col("block") / wide)))
    tops = first.groupBy("top").agg(F.min("first_id").alias("first_id"))
    alone = W.orderBy("top")
    tops = tops.select("top", F.coalesce(F.lead("first_id").over(alone), F.first("first_id").over(
        alone.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("after"))
    inner = first.withColumn("next_id", F.lead("first_id").over(W.partitionBy("top").orderBy("block")))
    return inner.join(F.broadcast(tops), "top").select("block", F.coalesce("next_id", "after").alias("next_id"))


def with_next(docs: DataFrame, compute) -> DataFrame:
    """``compute(docs)`` (adds columns to ``doc_id, text``) beside ``next``, a struct of the next document's columns.

    The text of every document is shuffled once, by blocks of ids; the first
    document of the following block stands at the end of each block as a sentinel.
    """
    d = keyed_texts(docs)
    firsts = next_firsts(d)
    if firsts.count() <= BROADCAST_ROWS:  # 16 bytes a row; beyond it a shuffled join
        firsts = F.broadcast(firsts)
    edge = d.join(firsts, F.col("doc_id") == F.col("next_id")).select(
        "doc_id", "text", "block", F.lit(True).alias("sentinel"))
    rows = d.select("doc_id", "text", F.floor(F.col("doc_id") / BLOCK).alias("block"),
                    F.lit(False).alias("sentinel")).unionByName(edge)
    rows = compute(rows)
    own = [c for c in rows.columns if c not in ("block", "sentinel")]
    order = W.partitionBy("block").orderBy("sentinel", "doc_id", "text")
    return (rows.withColumn("next", F.lead(F.struct(*own)).over(order)).where(~F.col("sentinel"))
            .select(*own, "next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the second half replaced from the next document."""
    rows = with_next(table(spark, sf_dir, "documents"),
                     lambda d: d.withColumn("n_chars", F.char_length("text").cast("long"))
                     .withColumn("h", hashes(winnow(F.col("text")))))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
                      F.coalesce(F.substring(F.col("next.text"), F.lit(1), half), F.lit("")))
    none = F.array().cast("array<bigint>")
    rows = rows.select("doc_id", "n_chars", "h", F.coalesce(F.col("next.h"), none).alias("next_h"),
                       edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "h", "next_h", F.struct(
        F.sha2("edited", 256).alias("sha"), hashes(winnow(F.col("edited"))).alias("h")).alias("e"))
    return rows.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"),
                       fingerprint_string(F.col("h")).alias("fingerprint"),
                       fingerprint_string(F.col("e.h")).alias("edited_fingerprint"),
                       likeness(F.col("h"), F.col("e.h")).alias("near_edited"),
                       likeness(F.col("h"), F.col("next_h")).alias("near_next"))


def _sql_hashes(text: str) -> str:
    words = f"list_filter(regexp_split_to_array({text}, '[\\t-\\r ]+'), lambda w: w <> '')"
    gram = (f"list_transform(range(1, greatest(len(ws) - {GRAM - 1}, least(len(ws), 1)) + 1), lambda i: "
            f"('0x' || substr(md5(array_to_string(ws[i:i + {GRAM - 1}], ' ')), 1, 9))::BIGINT * {1 << POS_BITS} "
            f"+ ({POS} - (i - 1)))")
    least = (f"list_transform(range(1, greatest(len(ks) - {WINDOW - 1}, least(len(ks), 1)) + 1), lambda i: "
             f"list_min(ks[i:i + {WINDOW - 1}]) >> {POS_BITS})")
    one = "list_transform([{}], lambda {}: {})[1]"
    return one.format(words, "ws", one.format(gram, "ks", f"list_sort(list_distinct({least}))"))


def op10_sql() -> str:
    text = "array_to_string(list_transform({}, lambda h: format('{{:09X}}', h)), ',')"
    like = ("CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({0}, {1}))::DOUBLE / "
            "(len({0}) + len({1}) - len(list_intersect({0}, {1}))) END")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text) AS n_chars,
  coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS nt FROM d),
e AS (SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(nt, 1, n_chars // 2) AS edited FROM n),
h AS (SELECT *, {_sql_hashes('text')} AS a, {_sql_hashes('edited')} AS b, {_sql_hashes('nt')} AS c FROM e)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {text.format('a')} AS fingerprint,
  {text.format('b')} AS edited_fingerprint, {like.format('a', 'b')} AS near_edited,
  {like.format('a', 'c')} AS near_next FROM h"""
