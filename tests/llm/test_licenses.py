import random
import re

import pytest

from cellgauge.llm import licenses


def brute_words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text):
    words = brute_words(text)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_columns_equal_brute_force(spark, awkward, documents):
    rows = awkward.select("doc_id", "text").unionByName(documents.select("doc_id", "text"))
    for r in licenses.scan_licenses(rows).collect():
        x = r.licenses
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute(r.text)
        assert 0 <= x.score <= 1 and set(x.base_labels.split(",")) <= set(x.labels.split(",")) | {""}


def test_overlapping_phrases():
    scan = licenses.Scanner({"a a": "x"}, {}).scan(b"a a a, a")
    assert scan[:4] == (4, 3, 0, 2)


def test_optional_and_replaceable_regions():
    t = 'Granted <<beginOptional>>freely <<beginOptional>>and openly<<endOptional>><<endOptional>> to <<var;max=2>> by us'
    automaton = licenses.compile_template(t)

    def accepts(text):
        return automaton.longest(licenses.words_of(text.encode()), 0) == len(licenses.words_of(text.encode()))

    assert automaton.mandatory == 4
    for yes in ("granted to by us", "Granted, FREELY to you by us", "granted freely and openly to you all by us"):
        assert accepts(yes), yes
    for no in ("granted openly to you by us", "granted to a b c by us", "granted to you by", "to by us"):
        assert not accepts(no), no


def test_automaton_equals_regular_expression():
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "d"]
    for _ in range(200):
        parts, opened = [], 0
        for _ in range(rng.randint(1, 7)):
            kind = rng.random()
            if kind < 0.2:
                parts.append("<<beginOptional>>")
                opened += 1
            elif kind < 0.35 and opened:
                parts.append("<<endOptional>>")
                opened -= 1
            elif kind < 0.5:
                parts.append(f"<<var;max={rng.randint(0, 2)}>>")
            else:
                parts.append(rng.choice(vocabulary))
        markup = " ".join(parts + ["<<endOptional>>"] * opened)
        automaton, pattern = licenses.compile_template(markup), re.compile(licenses.twin_pattern(markup))
        for _ in range(20):
            words = rng.choices(vocabulary, k=rng.randint(0, 6))
            accepted = automaton.longest([w.encode() for w in words], 0) == len(words)
            assert accepted == bool(pattern.fullmatch("".join(f" {w} " for w in words))), (markup, words)


def test_unbalanced_markup_is_an_error():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>> b"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


def test_empty_table_and_clashing_column(spark, awkward):
    assert licenses.scan_licenses(awkward.limit(0)).count() == 0
    again = licenses.scan_licenses(licenses.scan_licenses(awkward))
    assert again.columns == [*awkward.columns, "licenses"] and again.count() == awkward.count()
