"""Quality rules: base rules plus robust multivariate outliers, in DataFrame and SQL functions.

Statistics of each text: words, their code points, symbols, repeated lines, and
words inside repeated 8-word windows. The base rules fail very short and very
repetitive texts. All others enter a minimum-covariance-determinant estimate of their
language and source: four transformed statistics, an initial subset nearest to
the coordinate medians, then concentration steps that keep the ``SHARE`` of texts
with the smallest Mahalanobis distance and re-estimate mean and covariance from
them. Texts farther than ``CUTOFF`` in the final metric are rejected.

Every step is one aggregate over (language, source, distance bin): counts, sums and
products per bin, from which the subset's moments follow exactly, so a source that
holds a third of all rows is summed in parts. Statistics are whole numbers
(``UNIT`` to one) and sums are exact decimals, so the result does not depend on
how rows are dealt out.

Defined results: a null text has no words and fails; null language or source is a
group of its own; a group's covariance never falls under ``FLOOR``, so small and
constant groups reject nothing near their centre; repeated rows count as often as
they occur; extra columns are ignored; an empty table gives an empty frame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import materialise, table
from codescope.llm.fingerprints import let

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
UNIT = 1 << 14
SHARE_NUM, SHARE_DEN = 3, 4
STEPS = 3
CUTOFF = 36.0
#: Least standard deviation of each transformed statistic.
FLOOR = (0.08, 0.08, 0.13, 0.13)
BIN = 32


def repeat_words(ws: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text."""
    hs = F.transform(F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (WINDOW - 1), F.lit(0))),
                     lambda _, i: F.xxhash64(F.slice(ws, i + 1, F.lit(WINDOW))))

    def covered(h):
        def starts(s):
            same = lambda j, k: F.try_element_at(s, k)["h"] == F.element_at(s, j)["h"]
            return F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(
                ((j > 0) & same(j + 1, F.greatest(j, F.lit(1)))) | F.coalesce(same(j + 1, j + 2), F.lit(False)),
                x["i"])), lambda p: p.isNotNull()))

        def total(p):
            return F.aggregate(F.transform(p, lambda x, j: F.least(
                F.lit(WINDOW), F.coalesce(F.try_element_at(p, j + 2) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x)

        s = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(s, lambda v: let(starts(v), total)))

    return let(hs, covered)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the five counts of every whole text, with ``n_lines`` (lines with a word)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = let(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        repeat_words(ws).cast("long").alias("n_repeat_words")))
    ls = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                       (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = docs.select("doc_id", "lang", "source", w.alias("w"), ls.alias("l"),
                       F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols",
                       F.col("l.dup").alias("n_dup_lines"), "w.n_repeat_words", F.col("l.n").alias("n_lines"))


BASE_FAILED = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"


def verdict_sql(stats: str, tag: str = "", cutoff: float = CUTOFF,
                steps: int = STEPS) -> tuple[list[tuple[str, str]], str]:
    """The estimate as SQL over a table of :func:`statistics`: named queries in order, and the final one.

    The same text runs on other SQL engines, there as common table expressions.
    """
    d, v = len(FLOOR), range(len(FLOOR))
    pairs = [(i, j) for i in v for j in v if j <= i]
    values = ["ln(CAST(NULLIF(word_chars, 0) AS DOUBLE) / NULLIF(n_words, 0))",
              "sqrt(CAST(n_symbols AS DOUBLE) / NULLIF(n_words, 0))",
              "sqrt(CAST(n_dup_lines AS DOUBLE) / NULLIF(n_lines, 0))",
              "sqrt(CAST(n_repeat_words AS DOUBLE) / NULLIF(n_words, 0))"]
    T = tag
    ctes = [(f"{T}x", f"SELECT *, {BASE_FAILED} AS base_failed, " + ", ".join(
        f"CAST(floor({e} * {UNIT} + 0.5) AS BIGINT) AS x{i}" for i, e in enumerate(values)) + f" FROM {stats}"),
        (f"{T}good", "SELECT lang, source, " + ", ".join(f"x{i}" for i in v) + f" FROM {T}x WHERE NOT base_failed")]
    same = "a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source"
    # coordinate medians: the lowest bin at which half of the group is reached
    for i in v:
        ctes.append((f"{T}c{i}", f"SELECT lang, source, x{i} AS q, count(*) AS n FROM {T}good GROUP BY lang, source, x{i}"))
        ctes.append((f"{T}m{i}", f"SELECT lang, source, min(CASE WHEN 2 * upto >= n_all THEN q END) AS m FROM ("
                    f"SELECT lang, source, q, sum(n) OVER (PARTITION BY lang, source ORDER BY q) AS upto, "
                    f"sum(n) OVER (PARTITION BY lang, source) AS n_all FROM {T}c{i}) t GROUP BY lang, source"))
    eye = ", ".join(f"{FLOOR[i] * 2 * UNIT!r} AS l{i}{j}" if i == j else f"0.0 AS l{i}{j}" for i, j in pairs)
    joins = " ".join(f"JOIN {T}m{i} q{i} ON q0.lang IS NOT DISTINCT FROM q{i}.lang AND "
                     f"q0.source IS NOT DISTINCT FROM q{i}.source" for i in v[1:])
    cast = lambda t: ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in t)
    names = [f"u{i}" for i in v] + [f"l{i}{j}" for i, j in pairs]
    ctes.append((f"{T}p0", f"SELECT lang, source, {cast(names)} FROM (SELECT q0.lang AS lang, q0.source AS source, "
                 + ", ".join(f"q{i}.m AS u{i}" for i in v) + f", {eye} FROM {T}m0 q0 {joins}) t"))

    def distances(k: int, of: str = "", kind: str = "JOIN") -> str:
        """Squared Mahalanobis distance of every text under the estimate ``pk``, by forward substitution."""
        sql = f"SELECT a.*, {', '.join('b.' + n for n in names)} FROM {of or T + 'good'} a {kind} {T}p{k} b ON {same}"
        for i in v:
            less = "".join(f" - l{i}{j} * y{j}" for j in range(i))
            sql = f"SELECT *, (x{i} - u{i}{less}) / l{i}{i} AS y{i} FROM ({sql}) t{i}"
        return f"SELECT *, {' + '.join(f'y{i} * y{i}' for i in v)} AS d2 FROM ({sql}) t"

    for k in range(steps):
        sums = ", ".join([f"sum(CAST(x{i} AS DECIMAL(20,0))) AS s{i}" for i in v]
                         + [f"sum(CAST(x{i} * x{j} AS DECIMAL(20,0))) AS s{i}{j}" for i, j in pairs])
        ctes.append((f"{T}b{k}", f"SELECT lang, source, bin, count(*) AS n, {sums} FROM (SELECT *, "
                    f"CAST(floor(sqrt(d2) * {BIN}) AS BIGINT) AS bin FROM ({distances(k)}) t) t2 "
                    f"GROUP BY lang, source, bin"))
        kept = ", ".join(f"CAST(sum(s{n}) AS DOUBLE) AS s{n}" for n in [str(i) for i in v] + [f"{i}{j}" for i, j in pairs])
        ctes.append((f"{T}h{k}", f"SELECT lang, source, CAST(sum(n) AS DOUBLE) AS n, {kept} FROM (SELECT *, "
                    f"sum(n) OVER (PARTITION BY lang, source ORDER BY bin) - n AS below, "
                    f"sum(n) OVER (PARTITION BY lang, source) AS n_all FROM {T}b{k}) t "
                    f"WHERE below * {SHARE_DEN} < n_all * {SHARE_NUM} GROUP BY lang, source"))
        sql = "SELECT lang, source, " + ", ".join(f"s{i} / n AS u{i}" for i in v) + ", " + ", ".join(
            f"(s{i}{j} - s{i} * s{j} / n) / n" + (f" + {(FLOOR[i] * UNIT) ** 2!r}" if i == j else "") + f" AS c{i}{j}"
            for i, j in pairs) + f" FROM {T}h{k}"
        for i, j in pairs:  # Cholesky factor, one column after another
            if i != j:
                continue
            less = "".join(f" - l{i}{m} * l{i}{m}" for m in range(i))
            sql = f"SELECT *, sqrt(c{i}{i}{less}) AS l{i}{i} FROM ({sql}) t{i}"
            below = [f"(c{r}{i}" + "".join(f" - l{r}{m} * l{i}{m}" for m in range(i)) + f") / l{i}{i} AS l{r}{i}"
                     for r in range(i + 1, d)]
            if below:
                sql = f"SELECT *, {', '.join(below)} FROM ({sql}) q{i}"
        ctes.append((f"{T}p{k + 1}", f"SELECT lang, source, {', '.join(names)} FROM ({sql}) t"))
    return ctes, ("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, "
                  f"NOT base_failed AND coalesce(d2 <= {cutoff!r}, false) AS kept "
                  f"FROM ({distances(steps, T + 'x', 'LEFT JOIN')}) t")


def quality(docs: DataFrame, cutoff: float = CUTOFF, steps: int = STEPS) -> DataFrame:
    """Statistics and verdict of every document; the statistics are written once and read by each step."""
    spark, tag = docs.sparkSession, f"mcd_{uuid.uuid4().hex}_"
    materialise(statistics(docs), "quality").createOrReplaceTempView(f"{tag}stats")
    named, final = verdict_sql(f"{tag}stats", tag, cutoff, steps)
    for name, sql in named:
        df = spark.sql(sql)
        if name[len(tag)] == "p":  # estimates: a row for each group; written, so that each step is one short job
            df = materialise(df, "mcd")
        df.createOrReplaceTempView(name)
    return spark.sql(final)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the outlier verdict over all documents."""
    return quality(table(spark, sf_dir, "documents"))


def op6_sql() -> str:
    """The statistics in list functions, then the same estimate."""
    named, final = verdict_sql("stats")
    ws = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {ws} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM
  (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
stats AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words,
  length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(ls)::BIGINT AS n_lines FROM w LEFT JOIN c USING (doc_id)),
{', '.join(f'{name} AS ({sql})' for name, sql in named)} {final}"""
