"""X6 line rules, A14 violation count/density, X7 style score.

A documented subset of the linter the reference shells out to, computed as
array expressions over the line array of each source (no explode, no
shuffle, no Python). Rules (ours):

  E501  line longer than 100 characters
  W291  trailing whitespace on a line with content
  W293  whitespace on an otherwise blank line
  W191  indentation contains a tab
  E302  top-level ``def``/``class``/``async def``/decorator (not the first
        line, not right after a decorator) without two blank lines before it
  E702  a ';' in the code part of a line (text before the first '#')
  W292  no newline at end of a non-empty file
  W391  blank line(s) at end of file
  E999  syntax error (added where the parse result is known)
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codescope.functions.text import NONBLANK_RE, once, split_lines

# ---- fixed values ----
MAX_LINE_LENGTH = 100
DENSITY_CAP = 0.7
STYLE_WEIGHT, COVERAGE_WEIGHT = 0.7, 0.3
# -----------------------

TRAIL_WS_RE = "[ \\t\\x0b\\f]+\\z"
TAB_INDENT_RE = "\\A[ ]*\\t"
TOP_DEF_RE = "\\A(def |async def |class |@)"
DECORATOR_RE = "\\A@"


def _blank(x: Column) -> Column:
    return ~x.rlike(NONBLANK_RE)


def lint_counts(code: Column) -> Column:
    """Per-rule violation counts as a struct (line rules only, no E999)."""
    return once(split_lines(code), lambda lines: _line_counts(code, lines))


def _line_counts(code: Column, lines: Column) -> Column:
    def count(pred) -> Column:
        return F.size(F.filter(lines, pred))

    def prev(i: Column, k: int) -> Column:
        return F.element_at(lines, i + 1 - k)  # element_at is 1-based; i is 0-based

    e302 = F.size(F.filter(
        F.transform(lines, lambda x, i: F.when(
            (i > 0) & x.rlike(TOP_DEF_RE) & ~prev(i, 1).rlike(DECORATOR_RE)
            & ~((i >= 2) & _blank(prev(i, 1)) & _blank(prev(i, 2))), F.lit(1))),
        lambda v: v.isNotNull()))
    n = F.size(lines)
    last = F.element_at(lines, -1)
    return F.struct(
        count(lambda x: F.length(x) > MAX_LINE_LENGTH).alias("E501"),
        count(lambda x: x.rlike(NONBLANK_RE) & x.rlike(TRAIL_WS_RE)).alias("W291"),
        count(lambda x: _blank(x) & (F.length(x) > 0)).alias("W293"),
        count(lambda x: x.rlike(TAB_INDENT_RE)).alias("W191"),
        e302.alias("E302"),
        count(lambda x: F.split_part(x, F.lit("#"), F.lit(1)).contains(";")).alias("E702"),
        F.when((F.length(code) > 0) & ~code.endswith("\n"), 1).otherwise(0).alias("W292"),
        F.when((n > 0) & _blank(last), 1).otherwise(0).alias("W391"),
    )


def violation_total(counts: Column, parse_error: Column | None = None) -> Column:
    fields = ["E501", "W291", "W293", "W191", "E302", "E702", "W292", "W391"]
    total = sum((counts[f] for f in fields[1:]), counts[fields[0]])
    if parse_error is not None:
        total = total + F.when(parse_error.isNotNull(), 1).otherwise(0)
    return total


def violation_density(total: Column, nonblank_lines: Column) -> Column:
    """Violations per non-blank line, line floor 1."""
    return total / F.greatest(nonblank_lines, F.lit(1))


def style_score(density: Column, docstring_coverage: Column) -> Column:
    """max(0, 1 - min(density, 0.7)) * 0.7 + coverage * 0.3, 4 decimals (floor 0.21)."""
    return F.round(F.greatest(F.lit(0.0), 1 - F.least(density, F.lit(DENSITY_CAP))) * STYLE_WEIGHT
                   + docstring_coverage * COVERAGE_WEIGHT, 4)
