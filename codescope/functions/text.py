"""Text scalars as JVM-side Column expressions (whole-stage codegen, no Python).

X2 line table, A15 line counts, X8 code normalisation, X15 fenced-code
extraction, X16 whitespace word count, X21 output cap, X23 name bucket.
Each has a DuckDB twin in ``codescope.plans.oracle`` built from the same
pattern constants below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values (must equal Python's str semantics the reference relies on) ----
# Line terminators of Python str.splitlines(): CRLF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_BREAK_CHARS = "\\n\\r\\x0b\\f\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}"
# Whitespace of Python str.isspace() / str.strip() / str.split().
WS_CHARS = ("\\t\\n\\x0b\\f\\r \\x1c\\x1d\\x1e\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}")
OUTPUT_CAP_CHARS = 64000
OUTPUT_CAP_MARKER = "\n... [truncated: output exceeded 64KB]"
# First fenced block: ``` + optional language tag + newline, lazily up to the closing fence.
FENCE_RE = "(?s)```[a-zA-Z0-9_+-]*\\n(.*?)```"
NAME_BUCKETS = 6
# ---------------------------------------------------------------------------------

LINE_SPLIT_RE = f"\\r\\n|[{LINE_BREAK_CHARS}]"
NONBLANK_RE = f"[^{WS_CHARS}]"
RSTRIP_RE = f"[{WS_CHARS}]+\\z"
STRIP_RE = f"\\A[{WS_CHARS}]+|[{WS_CHARS}]+\\z"
WS_RUN_RE = f"[{WS_CHARS}]+"


def once(value: Column, fn) -> Column:
    """``fn(value)``, where ``value`` is computed once however often ``fn`` names it."""
    return F.transform(F.array(value), fn)[0]


def split_lines(text: Column) -> Column:
    """Python ``str.splitlines()`` as ARRAY<STRING> (no trailing empty line)."""
    return once(F.split(text, LINE_SPLIT_RE, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def line_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line, ``line_no`` from 1."""
    return df.select(id_col, F.posexplode(split_lines(F.col(text_col))).alias("pos", "line")) \
             .select(id_col, (F.col("pos") + 1).alias("line_no"), "line")


def is_blank(line: Column) -> Column:
    return ~line.rlike(NONBLANK_RE)


def line_count(text: Column) -> Column:
    """All lines (``len(code.splitlines())``). A split is many times faster than counting matches of a line."""
    return F.array_size(split_lines(text))


def nonblank_line_count(text: Column) -> Column:
    """Lines with a non-whitespace character."""
    return F.array_size(F.filter(split_lines(text), lambda x: x.rlike(NONBLANK_RE)))


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP_RE, "")


def normalize_code(text: Column) -> Column:
    """Cut each line at the first '#', right-strip, drop blank lines, join by LF."""
    cut = F.transform(split_lines(text),
                      lambda x: F.regexp_replace(F.split_part(x, F.lit("#"), F.lit(1)), RSTRIP_RE, ""))
    return F.array_join(F.filter(cut, lambda x: x != ""), "\n")  # blank lines are empty by now


def extract_code(text: Column) -> Column:
    """First fenced code block, stripped; no fence → the whole text stripped."""
    return F.when(text.rlike(FENCE_RE), py_strip(F.regexp_extract(text, FENCE_RE, 1))) \
            .otherwise(py_strip(text))


def word_count(text: Column) -> Column:
    """``len(text.split())``."""
    return F.size(F.filter(F.split(text, WS_RUN_RE, -1), lambda w: w != ""))


def truncate_output(text: Column) -> Column:
    """Keep the first 64 000 characters and append the marker line."""
    return F.when(F.length(text) > OUTPUT_CAP_CHARS,
                  F.concat(F.substring(text, 1, OUTPUT_CAP_CHARS), F.lit(OUTPUT_CAP_MARKER))) \
            .otherwise(text)


def name_bucket(name: Column) -> Column:
    """h = (h*31 + code) mod 2^32 over the characters, then mod 6."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    h = F.aggregate(chars, F.lit(0).cast("long"),
                    lambda acc, c: (acc * 31 + F.ascii(c)) % F.lit(4294967296))
    return (h % NAME_BUCKETS).cast("int")


# ---- X24 token-class profile (fixed values: keyword set and token alternation) ----
PY_KEYWORDS = ["def", "return", "if", "elif", "else", "for", "while", "in", "not", "and", "or",
               "import", "from", "as", "class", "try", "except", "finally", "raise", "with",
               "pass", "break", "continue", "lambda", "yield", "None", "True", "False",
               "is", "assert", "global", "nonlocal", "async", "await", "del"]
# Line terminators and whitespace as a browser regex sees them (no unicode flag).
JS_EOL = "\\n\\r\\x{2028}\\x{2029}"
JS_WS = "\\t\\n\\x0b\\f\\r \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
# Token alternation with ASCII \b (as a browser and RE2 read it) …
TOKEN_RE_ASCII_B = ("(#[^" + JS_EOL + "]*)"
                    "|('(?:[^'\\\\]|\\\\[^" + JS_EOL + "])*'|\"(?:[^\"\\\\]|\\\\[^" + JS_EOL + "])*\")"
                    "|(\\b[0-9]+\\.?[0-9]*\\b)"
                    "|(\\b[A-Za-z_][A-Za-z0-9_]*\\b)"
                    "|([^" + JS_WS + "])")
# … and for the JVM, whose \b is Unicode-aware on Java 17: the ASCII boundary spelled out.
# Before a digit or letter a boundary just means "no word character before"; after a maximal
# word run it always holds; after a number it depends on whether the number ends in '.'.
_W = "[A-Za-z0-9_]"
TOKEN_RE = ("(#[^" + JS_EOL + "]*)"
            "|('(?:[^'\\\\]|\\\\[^" + JS_EOL + "])*'|\"(?:[^\"\\\\]|\\\\[^" + JS_EOL + "])*\")"
            "|((?<!" + _W + ")[0-9]+\\.?[0-9]*(?:(?<=[0-9])(?!" + _W + ")|(?<=\\.)(?=" + _W + ")))"
            "|((?<!" + _W + ")[A-Za-z_][A-Za-z0-9_]*)"
            "|([^" + JS_WS + "])")


def token_profile(text: Column) -> Column:
    """Counts per token class: comment, string, number, keyword, name, punct.

    One regex pass writes every token between class marks, ``1 comment 2 string 3 number 4 word 5 other 6`` in
    control characters; an empty class leaves two marks side by side, so each class is counted by plain string
    replacement. Control characters of the text itself become another one of the same class first.
    """
    marks = [chr(i) for i in range(1, 7)]
    safe = F.translate(text, "".join(marks), chr(7) * 6)
    marked = F.regexp_replace(safe, TOKEN_RE, "".join(f"{m}${i}" for i, m in enumerate(marks[:5], 1)) + marks[5])

    def times(c: Column, what: str) -> Column:
        return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("int")

    n = times(marked, marks[5])
    n_comment, n_string, n_number, n_word = (n - times(marked, marks[i] + marks[i + 1]) for i in range(4))
    n_kw = F.size(F.filter(F.split(marked, marks[3]), lambda x: F.substring_index(x, marks[4], 1).isin(*PY_KEYWORDS)))
    return F.struct(
        n_comment.alias("comments"), n_string.alias("strings"), n_number.alias("numbers"),
        n_kw.alias("keywords"), (n_word - n_kw).alias("names"),
        (n - n_comment - n_string - n_number - n_word).alias("punct"))
