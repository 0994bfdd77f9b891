"""Mixing sources to target weights: budgets through a domain-language-source tree, in SQL functions.

Weights are whole numbers for domains, languages and sources. The token budget goes down
the tree: at each node it is shared among the children by weight, none gets
more than its subtree can give (its tokens times ``max_epochs``), and what a
child cannot take goes to its siblings by weight. A shortage is thus
made up by siblings before any ancestor's siblings get a share. All shares
are whole tokens and add up exactly.

A leaf spends its budget in epochs over its documents. Whole epochs take every document;
the last takes the prefix of the leaf in a seeded order (md5 of seed, epoch
and id), and cuts the document at which the budget ends. The prefix is found
from token sums of 4096 equal ranges of that order; only the range in which the
budget ends is sorted, so a leaf with a third of all rows is not one task.

Defined results: null and wordless texts have no token and are never selected; null language or
source counts as an empty name; weight 0 or unlisted with ``default`` 0
gets nothing; if all leaves together cannot meet the budget every one gives all it can;
repeated rows are documents of their own; an empty table gives an empty
frame; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codescope.llm.common import materialise, table

SEED = 17
MAX_EPOCHS = 2
BUDGET = (4, 5)  # share of all tokens
#: Production weights; domains are the source's number modulo 4.
WEIGHTS = {
    "domain": ({"web": 4, "books": 3, "code": 2, "forum": 1}, 0),
    "lang": ({"en": 5, "de": 2, "fr": 2}, 1),
    "source": ({"src0": 3, "src7": 2}, 1),
}
LEVELS = ("domain", "lang", "source")
TOKEN = "[^\\x20\\x09-\\x0D]+"


def domain_sql(regex_number: str) -> str:
    """Domain of a source by its number modulo 4; ``regex_number`` is the engine's expression for the number, as a string.

    Its last two digits decide, so a number of any length will do.
    """
    return (f"CASE WHEN {regex_number} = '' THEN 'web' ELSE CASE CAST(right({regex_number}, 2) AS BIGINT) % 4 "
            "WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' ELSE 'forum' END END")


def weight_sql(level: str, weights: dict) -> str:
    listed, default = weights[level]
    if not listed:
        return str(default)
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in listed.items()) + f" ELSE {default} END"


def budget_steps(docs: str, tag: str, share: tuple[int, int], max_epochs: int, weights: dict,
                 div: str, wide: str) -> list[tuple[str, str]]:
    """Named queries over ``docs(doc_id, domain, lang, source, n_tokens)`` that end in ``{tag}leaf``.

    ``div`` is the engine's whole-number division operator and ``wide`` a whole-number type of over 18 digits, for
    products of tokens and weights. The tables are as large as the tree.
    """
    out = [(f"{tag}n3", f"SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, "
                        f"CAST(sum(n_tokens) * {max_epochs} AS BIGINT) AS cap FROM {docs} GROUP BY domain, lang, source")]
    for k in (2, 1):
        keys = ", ".join(LEVELS[:k])
        out.append((f"{tag}n{k}", f"SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap FROM {tag}n{k + 1} GROUP BY {keys}"))
    out.append((f"{tag}b0", f"SELECT CAST(CAST(coalesce(sum(cap), 0) {div} {max_epochs} AS {wide}) * {share[0]} {div} {share[1]} AS BIGINT)"
                            f" AS budget FROM {tag}n1"))
    for k, level in enumerate(LEVELS):
        up = ", ".join(LEVELS[:k])
        part = f"PARTITION BY {up} " if k else ""
        keys = ", ".join(f"c.{x}" for x in LEVELS[:k + 1])
        on = " AND ".join(f"c.{x} = p.{x}" for x in LEVELS[:k]) or "true"
        tokens = ", tokens" if k == 2 else ""
        names = ", ".join(LEVELS[:k + 1]) + tokens
        # a child is full if its capacity is at most its share of what the children full before it leave
        out.append((f"{tag}b{k + 1}", f"""
SELECT {names}, CAST(CASE WHEN w = 0 THEN 0 WHEN is_full THEN cap
  ELSE CAST(rest AS {wide}) * upto {div} w_rest - CAST(rest AS {wide}) * (upto - w) {div} w_rest END AS BIGINT) AS budget
FROM (SELECT *, budget - coalesce(sum(CASE WHEN is_full THEN cap END) OVER ({part}), 0) AS rest,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS w_rest,
    sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}ORDER BY turn) AS upto
  FROM (SELECT *, w > 0 AND CAST(cap AS {wide}) * (w_all - w_before)
      <= CAST(budget - cap_before AS {wide}) * w AS is_full
    FROM (SELECT *, coalesce(sum(w) OVER ({part}ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
          AS w_before, sum(w) OVER ({part}) AS w_all,
        coalesce(sum(CASE WHEN w > 0 THEN cap END) OVER ({part}ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before
      FROM (SELECT *, row_number() OVER ({part}ORDER BY CASE WHEN w > 0 THEN 0 ELSE 1 END,
            CAST(cap AS DOUBLE) / CASE WHEN w > 0 THEN w ELSE 1 END, {level}) AS turn
        FROM (SELECT {keys}{tokens}, c.cap, p.budget, {weight_sql(f'c.{level}', {f'c.{level}': weights[level]})} AS w
          FROM {tag}n{k + 1} c JOIN {tag}b{k} p ON {on}) a) b) d) e) f"""))
    out.append((f"{tag}leaf", f"SELECT domain, lang, source, tokens, budget, budget {div} tokens AS whole, "
                              f"budget % tokens AS rest FROM {tag}b3 WHERE tokens > 0"))
    return out


def with_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens`` of the documents that have a token (words without white space)."""
    number = "regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)"
    return docs.select(
        "doc_id", F.expr(domain_sql(number)).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")
    ).where("n_tokens > 0")


def mix(counted: DataFrame, share: tuple[int, int] = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        weights: dict = WEIGHTS) -> DataFrame:
    """Selected documents ``doc_id, domain, lang, source, epoch, n_tokens, take_tokens``, a row for each epoch.

    ``counted`` is a written table of :func:`with_tokens`.
    """
    spark, tag = counted.sparkSession, f"mix_{uuid.uuid4().hex}_"
    counted.createOrReplaceTempView(f"{tag}docs")
    steps = budget_steps(f"{tag}docs", tag, share, max_epochs, weights, "div", "DECIMAL(38, 0)")
    for name, sql in steps[:-1]:
        df = spark.sql(sql)
        (materialise(df, "mix") if name == f"{tag}n3" else df).createOrReplaceTempView(name)
    leaf = materialise(spark.sql(steps[-1][1]), "leaves")
    key = ["domain", "lang", "source"]
    rows = counted.join(leaf.select(*key, "whole", "rest"), key).where("whole > 0 OR rest > 0")
    rows = rows.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "whole", "doc_id").cast("binary")))
    rows = rows.withColumn("range", F.substring("place", 1, 3))
    # where the last epoch's prefix ends: token sums of the ranges of its order
    sums = rows.where("rest > 0").groupBy(*key, "range", "rest").agg(F.sum("n_tokens").alias("n"))
    sums.createOrReplaceTempView(f"{tag}sums")
    end = materialise(spark.sql(f"""SELECT domain, lang, source, range AS end_range, before FROM (
        SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY range) - n AS before FROM {tag}sums) t
        WHERE before < rest AND before + n >= rest"""), "ends")
    rows = rows.join(end, key, "left")
    full = rows.where("whole > 0").select(
        "doc_id", *key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"),
        "n_tokens", F.col("n_tokens").alias("take_tokens"))
    early = rows.where("rest > 0 AND range < end_range").select(
        "doc_id", *key, F.col("whole").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    rows.where("rest > 0 AND range = end_range").createOrReplaceTempView(f"{tag}last")
    last = spark.sql(f"""SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens,
        least(n_tokens, rest - before) AS take_tokens FROM (
          SELECT * EXCEPT (before), before + sum(n_tokens) OVER (PARTITION BY domain, lang, source
            ORDER BY place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before
          FROM {tag}last) t WHERE before < rest""")
    return full.unionByName(early).unionByName(last)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of all tokens, mixed to the production weights with at most two epochs."""
    return mix(materialise(with_tokens(table(spark, sf_dir, "documents")), "tokens"))


def op3_sql() -> str:
    number = "regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)"
    docs = f"""d AS (SELECT doc_id, {domain_sql(number)} AS domain, coalesce(lang, '') AS lang,
  coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}'))::BIGINT AS n_tokens
  FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) > 0)"""
    ctes = ", ".join(f"{n} AS ({q})" for n, q in budget_steps("d", "t_", BUDGET, MAX_EPOCHS, WEIGHTS, "//", "HUGEINT"))
    return f"""
WITH {docs}, {ctes},
j AS (SELECT d.*, whole, rest, md5('{SEED}:' || whole || ':' || doc_id) AS place
  FROM d JOIN t_leaf l ON d.domain = l.domain AND d.lang = l.lang AND d.source = l.source),
e AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n_tokens
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS before FROM j)
SELECT doc_id, domain, lang, source, unnest(range(0, whole))::BIGINT AS epoch, n_tokens, n_tokens AS take_tokens FROM j
UNION ALL
SELECT doc_id, domain, lang, source, whole, n_tokens, least(n_tokens, rest - before)::BIGINT FROM e WHERE before < rest"""
