"""License scans: phrases and template markup compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgauge.llm.common import LOWER, UPPER, query, table

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates in matching-guideline markup: what stands between beginOptional and
#: endOptional may be missing; var stands for 0 to max words of any kind.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, <<beginOptional>>Version<<endOptional>> 2.0 "
    '<<beginOptional>>(the "License"); you may not use this file except in compliance with the License<<endOptional>>',
    "mit": "<<beginOptional>>This software is<<endOptional>> Released under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="what";max=6>> '
    "and associated documentation files",
    "gpl-3.0": "<<beginOptional>>This work is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> "
    "GNU General Public License, version 3 <<beginOptional>>or any later version<<endOptional>>",
    "cc-by-nc-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY NC 4.0 "
    "<<beginOptional>>International License<<endOptional>>",
    "cc-by-4.0": "<<beginOptional>>This work is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY 4.0 "
    "<<beginOptional>>International License<<endOptional>>",
    "copyright-notice": 'Copyright <<var;name="holder";max=8>> All rights reserved',
    "spdx": 'SPDX License Identifier <<var;name="id";max=1>>',
}

# every byte that is no letter, digit or part of a longer code point becomes a space
_WORDS = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b) in LOWER + "0123456789" else 0x20
    for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Words of the contract: A-Z lower-cased, cut at ASCII characters other than letters and digits."""
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """A template's token automaton without empty moves.

    ``moves[state]`` maps a word, or None for any word, to the states it leads to;
    ``start`` and ``ends`` are sets of states; ``mandatory`` counts its fixed words.
    """

    moves: tuple[Mapping[bytes | None, frozenset[int]], ...]
    start: frozenset[int]
    ends: frozenset[int]
    mandatory: int

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``, or -1."""
        states, best = self.start, -1
        while states:
            if states & self.ends:
                best = at
            if at == len(words):
                break
            word, following = words[at], set()
            for s in states:
                following |= self.moves[s].get(word, frozenset()) | self.moves[s].get(None, frozenset())
            states, at = frozenset(following), at + 1
        return best

    def first_words(self) -> frozenset[bytes | None]:
        return frozenset(w for s in self.start for w in self.moves[s])


_MARK = re.compile(r"<<(beginOptional|endOptional|var[^>]*)>>")


def compile_template(markup: str) -> Automaton:
    """Template markup to an automaton; optional regions may nest. Unbalanced markup is an error."""
    word_moves: list[dict] = [{}]
    skips: list[set[int]] = [set()]
    opened: list[int] = []
    mandatory = 0

    def add(word):
        word_moves.append({})
        skips.append(set())
        word_moves[-2].setdefault(word, set()).add(len(word_moves) - 1)

    for i, part in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            for word in words_of(part.encode()):
                add(word)
                mandatory += not opened
        elif part == "beginOptional":
            opened.append(len(word_moves) - 1)
        elif part == "endOptional":
            if not opened:
                raise ValueError(f"endOptional without beginOptional: {markup}")
            skips[opened.pop()].add(len(word_moves) - 1)
        else:
            most = re.search(r"max=(\d+)", part)
            begin = len(word_moves) - 1
            for _ in range(int(most[1]) if most else 16):
                add(None)
            for state in range(begin, len(word_moves) - 1):
                skips[state].add(len(word_moves) - 1)
    if opened:
        raise ValueError(f"beginOptional without endOptional: {markup}")

    def closure(states):
        pending, seen = list(states), set(states)
        while pending:
            for nxt in skips[pending.pop()] - seen:
                seen.add(nxt)
                pending.append(nxt)
        return frozenset(seen)

    moves = tuple({word: closure(to) for word, to in by.items()} for by in word_moves)
    return Automaton(moves, closure({0}), frozenset({len(word_moves) - 1}), mandatory)


class Scanner:
    """Phrases and templates, ready for many texts. Plain data, so it travels to tasks as it is."""

    def __init__(self, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES):
        self.phrases = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases.items()]
        self.automata = {label: compile_template(t) for label, t in templates.items()}
        # a rare word that every accepted run has: templates are only tried in texts that hold it
        self.needs = {label: [w for w in _required(a)] for label, a in self.automata.items()}

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, spans, score of one text."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts.append(at)
                base.add(label)
                at = line.find(phrase, at + 1)
        first, last = (line.count(b" ", 0, min(starts)), line.count(b" ", 0, max(starts))) if starts else (None, None)
        spans, score = [], 0.5 if base else 0.0
        for label, automaton in self.automata.items():
            if any(b" " + w + b" " not in line for w in self.needs[label]):
                continue
            begins, at = automaton.first_words(), 0
            while at < len(words):
                end = automaton.longest(words, at) if None in begins or words[at] in begins else -1
                if end > at:
                    spans.append((label, at, end))
                    score = max(score, 0.5 + 0.5 * automaton.mandatory / (end - at))
                    at = end
                else:
                    at += 1
        labels = base | {label for label, _, _ in spans}
        join = lambda found: ",".join(sorted(found))
        return len(words), len(starts), first, last, join(base), join(labels), spans, min(score, 1.0)


def _required(automaton: Automaton) -> list[bytes]:
    """Words without which nothing is accepted."""
    words = {w for by in automaton.moves for w in by if w is not None}

    def accepts_without(banned):
        seen, pending = set(automaton.start), list(automaton.start)
        while pending:
            for word, to in automaton.moves[pending.pop()].items():
                if word != banned:
                    pending += to - seen
                    seen |= to
        return bool(seen & automaton.ends)

    return sorted(w for w in words if not accepts_without(w))


RESULT = (
    "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,"
    "spans:array<struct<label:string,first:bigint,stop:bigint>>,score:double>"
)


def scan_licenses(documents: DataFrame, text_column: str = "text", out: str = "licenses", scanner: Scanner | None = None) -> DataFrame:
    """Add a struct with the phrases and templates found in every whole text.

    ``n_base`` counts the places of base phrases, overlapping ones too, ``first_word`` and
    ``last_word`` are their smallest and largest start in words (null without any);
    ``spans`` are the accepted template runs, longest first come, as [first, stop) words;
    ``labels`` joins base and template labels, sorted. ``score`` is 0 without a find, 0.5
    for base phrases only, else 0.5 plus half the share of mandatory words in the best run.
    Null and empty texts have no words and no finds. Rows are independent: repeated ones
    repeat their result. A clashing ``out`` is replaced; an empty table stays empty.
    """
    ready = scanner or Scanner()

    @F.arrow_udf(RESULT)
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([
            ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("stop", pa.int64())]))), ("score", pa.float64()),
        ])
        names = [f.name for f in kind]
        for batch in batches:
            found = [ready.scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.cast(pa.binary())]
            rows = [dict(zip(names, f)) | {"spans": [dict(zip(("label", "first", "stop"), s)) for s in f[6]]} for f in found]
            yield pa.array(rows, kind)

    return documents.withColumn(out, udf(F.col(text_column).cast("string")))


def twin_pattern(markup: str) -> str:
    """A template as a regular expression over words that each stand between spaces of their own."""
    out = []
    for i, part in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            out += [" " + w.decode() + " " for w in words_of(part.encode())]
        elif part == "beginOptional":
            out.append("(?:")
        elif part == "endOptional":
            out.append(")?")
        else:
            out.append("(?: [^ ]+ ){0,%s}" % (m[1] if (m := re.search(r"max=(\d+)", part)) else 16))
    return "".join(out)


def _sql() -> str:
    finds = ", ".join(
        f"list_transform(list_filter(range(1, length(line) + 1), lambda i: substr(line, i, {len(p) + 2}) = ' {p} '), "
        "lambda i: length(substr(line, 1, i)) - length(replace(substr(line, 1, i), ' ', '')) - 1)"
        for p in PHRASES
    )
    base = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    more = ", ".join(f"CASE WHEN regexp_matches(wide, '{twin_pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    best = []
    for label, t in TEMPLATES.items():
        mandatory = compile_template(t).mandatory
        best.append(
            f"coalesce(list_max(list_transform(regexp_extract_all(wide, '{twin_pattern(t)}'), "
            f"lambda x: 0.5::DOUBLE + 1.0::DOUBLE * {mandatory} / (length(x) - length(replace(x, ' ', ''))))), 0.0::DOUBLE)"
        )
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
l AS (SELECT doc_id, len(words)::BIGINT AS n_words, ' ' || list_aggregate(words, 'string_agg', ' ') || ' ' AS line FROM w),
k AS (SELECT doc_id, n_words, coalesce(line, '  ') AS line, replace(coalesce(line, ''), ' ', '  ') AS wide FROM l),
f AS (SELECT doc_id, n_words, line, wide, CASE WHEN {' OR '.join(f"contains(line, ' {p} ')" for p in PHRASES)}
  THEN flatten([{finds}]) ELSE [] END AS places FROM k)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
  array_to_string(list_sort(list_filter([{base}], lambda x: x IS NOT NULL)), ',') AS base_labels,
  array_to_string(list_sort(list_filter([{base}, {more}], lambda x: x IS NOT NULL)), ',') AS labels,
  least(1.0::DOUBLE, greatest(CASE WHEN len(places) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, {', '.join(best)})) AS score
FROM f
"""


@query("op9_license_scans", _sql())
def op9_license_scans(spark, sf):
    found = scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", *[F.col(f"licenses.{n}").alias(n) for n in names])
