"""License scans: templates with optional and replaceable regions, compiled into token automata.

Template markup: plain words are mandatory; `[[ ... ]]` is optional (may nest); `{{n}}` stands for up to n words of
any wording. Words are compared after lower-casing A-Z and splitting at ASCII characters other than letters and
digits. A text gets a template's label if some run of its words is accepted by the automaton, that is if all the
mandatory wording stands there exactly. Base phrases are found beside it.

A null text counts as empty; empty texts get zero counts, null positions and empty labels. Whole texts are scanned.
Repeated rows stay repeated; an empty table gives an empty result; extra columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The fixed base phrases of op1.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Template -> label. Notices, and the whole grants of two short licenses.
TEMPLATES = {
    "[[this {{3}} is]] released under the mit license": "mit-notice",
    "[[this {{3}} is]] licensed under the apache license version 2 [[0]] [[the license]]": "apache-2-notice",
    "[[this {{3}} is]] licensed under [[a]] [[creative commons]] cc by nc [[4 0]] [[international]]": "cc-by-nc-notice",
    "this {{3}} is licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3": "gpl-3-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction": "mit-text",
    "permission to use copy modify [[and or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
}
#: Every byte that is no ASCII letter or digit becomes a space; A-Z becomes a-z; bytes of other characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def _parse(template: str) -> list:
    """Nested list of words (str), gaps (int) and optional regions (list)."""
    stack: list[list] = [[]]
    for mark in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", template):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            inner = stack.pop()
            stack[-1].append(inner)
        elif mark[0] == "{":
            stack[-1].append(int(mark.strip("{}")))
        else:
            stack[-1].append(mark)
    if len(stack) != 1:
        raise ValueError(f"unbalanced optional region in {template!r}")
    return stack[0]


class TokenAutomaton:
    """Nondeterministic automaton over words: edges[state] = [(word or None for any, next state)], with free moves."""

    def __init__(self, template: str) -> None:
        self.edges: list[list[tuple[str | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.runs: list[bytes] = []
        self._run: list[str] = []
        self.end = self._add(_parse(template), 0, True)
        self._close_run()
        self.start = self._reach({0})
        if self.end in self.start:
            raise ValueError(f"template without mandatory words: {template!r}")
        self.first = {w for s in self.start for w, _ in self.edges[s]}

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _close_run(self) -> None:
        if self._run:
            self.runs.append(b" " + " ".join(self._run).encode() + b" ")
        self._run = []

    def _add(self, items: list, at: int, mandatory: bool) -> int:
        for x in items:
            if isinstance(x, str):
                to = self._state()
                self.edges[at].append((x, to))
                if mandatory:
                    self._run.append(x)
            elif isinstance(x, int):
                self._close_run()
                ends, to = [at], at
                for _ in range(x):
                    to, was = self._state(), to
                    self.edges[was].append((None, to))
                    ends.append(to)
                to = self._state()
                for s in ends:
                    self.free[s].append(to)
            else:
                self._close_run()
                inner = self._add(x, at, False)
                to = self._state()
                self.free[at].append(to)
                self.free[inner].append(to)
            at = to
        return at

    def _reach(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def accepts_at(self, words: list[str], i: int) -> bool:
        live = self.start
        while True:
            if self.end in live:
                return True
            if i >= len(words) or not live:
                return False
            live = self._reach({t for s in live for w, t in self.edges[s] if w is None or w == words[i]})
            i += 1

    def found(self, spaced: bytes, words: list[str]) -> bool:
        """spaced: the words, a space before, between and after them. The mandatory runs are looked for first."""
        if not all(run in spaced for run in self.runs):
            return False
        return any(self.accepts_at(words, i) for i, w in enumerate(words) if None in self.first or w in self.first)


def template_regex(template: str) -> str:
    """The same language as a regular expression over words that each end in a space; for cross-checks."""

    def put(items: list) -> str:
        return "".join(f"{x} " if isinstance(x, str) else f"([^ ]+ ){{0,{x}}}" if isinstance(x, int) else f"({put(x)})?" for x in items)

    return " " + put(_parse(template))


def scan_text(raw: bytes, phrases: Mapping[bytes, str], automata: list[tuple[TokenAutomaton, str]]) -> tuple:
    split = raw.translate(_TABLE).split()
    spaced = b" " + b" ".join(split) + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        at, word, seen = spaced.find(phrase), 0, 0
        while at >= 0:
            word, seen = word + spaced.count(b" ", seen, at), at
            places.append(word)
            base.add(label)
            at = spaced.find(phrase, at + 1)
    more, words = set(), None
    for automaton, label in automata:
        if all(run in spaced for run in automaton.runs):
            words = words if words is not None else [w.decode() for w in split]
            if automaton.found(spaced, words):
                more.add(label)
    score = 1.0 if more else 0.5 if base else 0.0
    return len(split), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def scan_licenses(df: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each input row.

    score: 1 if a template accepts part of the text, 0.5 if only a base phrase stands there, else 0.
    """
    kind = df.schema[id_col].dataType.simpleString()
    plain = {f" {k} ".encode(): v for k, v in phrases.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [(TokenAutomaton(t), label) for t, label in templates.items()]
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            rows = [scan_text(texts[i].as_py() or b"", plain, automata) for i in range(len(texts))]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return df.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    at = [(f"list_filter(range(1, len(w) + 1), lambda i: list_slice(w, i, i + {len(p.split()) - 1}) = {p.split()!r})", label) for p, label in PHRASES.items()]
    base = ", ".join(f"CASE WHEN len({a}) > 0 THEN '{label}' END" for a, label in at)
    more = ", ".join(f"CASE WHEN regexp_matches(spaced, '{template_regex(t)}') THEN '{label}' END" for t, label in TEMPLATES.items())
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, list_concat({", ".join(a for a, _ in at)}) AS places,
    list_filter([{base}], lambda x: x IS NOT NULL) AS base, ' ' || array_to_string(w, ' ') || ' ' AS spaced FROM words),
marked AS (SELECT *, list_filter([{more}], lambda x: x IS NOT NULL) AS more FROM found)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word,
    array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, more))), ',') AS labels,
    CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM marked
"""


OP1_SQL = _sql()
