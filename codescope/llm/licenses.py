"""License scans: template markup compiled into token automata and run over whole texts.

A template is wording with two kinds of marked regions:

* ``[[ ... ]]``  optional: the region may be present or absent (regions nest);
* ``{{lo-hi}}``  replaceable: any ``lo`` to ``hi`` words may stand here.

Everything else is mandatory and must match word for word. Templates (the base
phrases are templates without regions) compile into one position automaton: a
state per word position, an edge per word, free edges over optional regions and
counted wildcard states for replaceable ones. The automaton runs online over the
words of a text, so memory is bounded by the states, not by the text.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only.
Defined results: null and empty texts have no words, no places and score 0; ties
(several templates at one place) are all reported; an empty table gives an empty
frame; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from codescope.llm.common import LOWER_AZ, keyed_texts, map_batches, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CHUNK = 1 << 18

#: Base phrases: phrase -> label.
BASE = {"the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template) pairs of the method: notices as projects commonly write them.
TEMPLATES = (
    ("mit", "released [[under [[the]]]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this {{1-8}} "
            "and associated documentation files"),
    ("apache-2", "licensed under the apache license [[version]] 2 [[0]]"),
    ("cc-by-nc", "licensed under [[a]] [[the]] [[creative commons]] cc by nc {{0-2}} [[international]]"),
    ("cc-by-nc", "creative commons attribution non commercial [[{{0-2}} international]]"),
    ("gpl-3", "licensed under the gnu general public license [[as published by the free software foundation]] "
              "[[either]] version 3"),
    ("gpl-2", "gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
)

ANY = None


def compile_templates(templates) -> tuple[list[dict], list[frozenset], list[tuple | None]]:
    """Compile ``(label, template, is_base)`` rows into ``(edges, starts, accepts)``.

    ``edges[s]`` maps a word (or ``ANY``) to the states reached, free edges already
    followed; ``starts[t]`` are the states template ``t`` starts in; ``accepts[s]``
    is ``(t, mandatory words)`` where ``s`` ends template ``t``.
    """
    edges: list[dict] = []
    free: list[list[int]] = []
    accepts: list = []

    def state() -> int:
        edges.append({})
        free.append([])
        accepts.append(None)
        return len(edges) - 1

    heads = []
    for t, (_, text, _) in enumerate(templates):
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", text)
        at, opened, must = state(), [], 0
        heads.append(at)
        for tok in tokens:
            if tok == "[[":
                opened.append(at)
                nxt = state()
                free[at].append(nxt)
                at = nxt
            elif tok == "]]":
                nxt = state()
                free[at].append(nxt)
                free[opened.pop()].append(nxt)
                at = nxt
            elif tok.startswith("{{"):
                lo, hi = map(int, tok[2:-2].split("-"))
                skip = []
                for k in range(hi):
                    if k >= lo:
                        skip.append(at)
                    nxt = state()
                    edges[at].setdefault(ANY, []).append(nxt)
                    at = nxt
                for s in skip:
                    free[s].append(at)
            else:
                nxt = state()
                edges[at].setdefault(tok, []).append(nxt)
                must += not opened
                at = nxt
        if opened:
            raise ValueError(f"unclosed optional region: {text!r}")
        accepts[at] = (t, must)

    def closure(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for n in free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    closed = [{w: closure(ns) for w, ns in e.items()} for e in edges]
    return closed, [closure([h]) for h in heads], accepts


class Scanner:
    """Runs the automaton over words that arrive in lists; keeps live threads between lists."""

    def __init__(self, templates):
        self.edges, self.heads, self.accepts = compile_templates(templates)
        self.starts: dict[str, list[tuple[int, int]]] = {}
        self.must = {}
        for t, head in enumerate(self.heads):
            for s in head:
                if self.accepts[s]:
                    raise ValueError(f"template {t} has no mandatory word")
                if ANY in self.edges[s]:
                    raise ValueError(f"template {t} starts with a replaceable region")
                for w in self.edges[s]:
                    self.starts.setdefault(w, []).append((t, s))
        self.must = {a[0]: a[1] for a in self.accepts if a}

    def scan(self, text: str) -> tuple[int, dict[tuple[int, int], int]]:
        """Number of words and ``{(template, first word): last word + 1}``, the longest match for each."""
        n, found, threads = 0, {}, set()
        starts, edges, accepts = self.starts, self.edges, self.accepts
        for words in word_lists(text):
            at = 0
            hot = [i for i, w in enumerate(words) if w in starts]
            hot.append(len(words))
            for i in hot:
                while threads and at < i:  # threads alive from earlier words
                    threads = self._step(threads, words[at], n + at, found)
                    at += 1
                if i == len(words):
                    break
                at = i + 1
                threads = self._step(threads, words[i], n + i, found)
                for t, s in starts[words[i]]:
                    for s2 in edges[s][words[i]]:
                        threads.add((t, n + i, s2))
                        if accepts[s2]:
                            found[t, n + i] = n + i + 1
            n += len(words)
        return n, found

    def _step(self, threads: set, word: str, pos: int, found: dict) -> set:
        out = set()
        for t, first, s in threads:
            for key in (word, ANY):
                for s2 in self.edges[s].get(key, ()):
                    out.add((t, first, s2))
                    if self.accepts[s2]:
                        found[t, first] = max(found.get((t, first), 0), pos + 1)
        return out


def word_lists(text: str) -> Iterator[list[str]]:
    """Words of ``text`` in lists of bounded size; a text is cut between words only."""
    text = text.translate(LOWER_AZ) if not text.islower() else text
    if len(text) <= CHUNK:
        yield WORD.findall(text)
        return
    out = []
    for m in WORD.finditer(text):
        out.append(m.group())
        if len(out) >= CHUNK // 8:
            yield out
            out = []
    yield out


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, templates=TEMPLATES) -> DataFrame:
    """One row per document with all places found.

    Columns: ``doc_id, n_words, places array<struct<label, template, is_base,
    first_word, last_word, mandatory>>`` (words counted from 0, last inclusive),
    sorted by first word and template.
    """
    rows = [(label, phrase, True) for phrase, label in base.items()] + [(*t, False) for t in templates]

    def run(batches):
        scanner = Scanner(rows)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            n_words, places = [], []
            for text in texts:
                n, found = scanner.scan(text)
                n_words.append(n)
                places.append([{"label": rows[t][0], "template": t, "is_base": rows[t][2], "first_word": first,
                                "last_word": end - 1, "mandatory": scanner.must[t]}
                               for (t, first), end in sorted(found.items(), key=lambda x: (x[0][1], x[0][0]))])
            yield {"doc_id": ids, "n_words": n_words, "places": places}

    return map_batches(keyed_texts(docs), run,
                       "doc_id bigint, n_words bigint, places array<struct<label:string,template:int,is_base:boolean,"
                       "first_word:bigint,last_word:bigint,mandatory:int>>")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, their span, labels of base phrases and of all templates, and a score.

    ``score`` is m / (m + 2), m the most mandatory words of any matched template (0 without a match).
    """
    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "n_words",
        "cast(size(filter(places, p -> p.is_base)) AS bigint) AS n_base",
        "array_min(transform(filter(places, p -> p.is_base), p -> p.first_word)) AS first_word",
        "array_max(transform(filter(places, p -> p.is_base), p -> p.first_word)) AS last_word",
        "array_join(array_sort(array_distinct(transform(filter(places, p -> p.is_base), p -> p.label))), ',')"
        " AS base_labels",
        "array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',') AS labels",
        "coalesce(array_max(transform(places, p -> p.mandatory / (p.mandatory + 2.0D))), 0.0D) AS score")


def template_regex(template: str) -> tuple[str, int]:
    """A template as a regular expression over words joined by single spaces (each word with a leading space)."""
    out, depth, must = "", 0, 0
    for tok in re.findall(r"\[\[|\]\]|\{\{\d+-\d+\}\}|[^\s\[\]{}]+", template):
        if tok == "[[":
            out, depth = out + "(?:", depth + 1
        elif tok == "]]":
            out, depth = out + ")?", depth - 1
        elif tok.startswith("{{"):
            lo, hi = tok[2:-2].split("-")
            out += f"(?: [^ ]+){{{lo},{hi}}}"
        else:
            out += f" {tok}"
            must += not depth
    return out + " ", must


def op2_sql() -> str:
    rows = [(label, phrase) for phrase, label in BASE.items()] + list(TEMPLATES)
    hits = ",\n  ".join(f"regexp_matches(s, '{template_regex(t)[0]}') AS h{i}" for i, (_, t) in enumerate(rows))
    labels = ", ".join(f"CASE WHEN h{i} THEN '{label}' END" for i, (label, _) in enumerate(rows))
    score = ", ".join(f"CASE WHEN h{i} THEN {m} / ({m} + 2.0::DOUBLE) ELSE 0.0 END"
                      for i, (_, t) in enumerate(rows) for m in [template_regex(t)[1]])
    at = " OR ".join("(" + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split())) + ")"
                     for p in BASE)
    base = ", ".join(f"CASE WHEN h{i} THEN '{label}' END" for i, label in enumerate(BASE.values()))
    tidy = "array_to_string(list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL))), ',')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(len(w)), lambda i: coalesce({at}, false)) AS b,
    ' ' || array_to_string(w, ' ') || ' ' AS s FROM d),
h AS (SELECT *, {hits} FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word,
  list_max(b)::BIGINT AS last_word, {tidy.format(base)} AS base_labels, {tidy.format(labels)} AS labels,
  greatest({score})::DOUBLE AS score FROM h"""
