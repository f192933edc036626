import random

import pytest
import regex

from logquarry.llm import licenses
from logquarry.llm.common import alnum_words

FULL = "Released under the MIT License."


def scan(text):
    row = licenses.Scanner().scan(text)
    return dict(zip(licenses.SCHEMA.names[1:], row))


@pytest.mark.parametrize(
    "text, labels",
    [
        (FULL, "mit"),
        ("Licenced undr the Apache License, Versoin 2.0", "apache-2"),
        ("This work is licensed under the GNU General Publik License, version 3.", "gpl"),
        ("Licensed under CC-BY-NC 4.0 and released under the M1T License", "cc-by-nc,mit"),
        ("the license of the apache", ""),
        ("cc by ncx", ""),
        ("", ""),
        (None, ""),
    ],
)
def test_labels(text, labels):
    assert scan(text)["labels"] == labels


def test_spans_give_the_place_in_the_text():
    text = "Überall! Relaesed under the MIT-License, ja"
    span = scan(text)["spans"][0]
    assert text[span["start"] : span["end"]] == "Relaesed under the MIT-License"
    assert (span["first_word"], span["last_word"], span["edits"]) == (1, 5, 2)


def _base(words):
    places = {}
    for n in licenses.BASE:
        p = n.phrase.encode().split()
        places |= {i: n.label for i in range(len(words)) if words[i : i + len(p)] == p}
    return places


def _mangled(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        phrase = list(rng.choice([n.phrase for n in (*licenses.NOTICES, *licenses.BASE)] + ["lorem ipsum dolor"]))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(phrase))
            phrase[at : at + 1] = rng.choice([[], ["x"], [phrase[at], "y"], [" "]])
        out.append("".join(phrase))
    return rng.choice([" ", "\n", ", "]).join(out)


def test_equals_search_without_seeds():
    """Base places by comparing words; fuzzy labels wherever bounded-error search over the whole text finds one."""
    rng = random.Random(5)
    for _ in range(300):
        text = _mangled(rng)
        words, got = alnum_words(text), scan(text)
        base = _base(words)
        assert got["n_base"] == len(base) and got["base_labels"] == ",".join(sorted(set(base.values())))
        assert (got["first_word"], got["last_word"]) == ((min(base), max(base)) if base else (None, None))
        line = f" {b' '.join(words).decode()} "
        found = {
            n.phrase for n in licenses.NOTICES if regex.search(f"(?:{regex.escape(n.phrase)}){{e<={n.edits}}}", line)
        }
        best = {s["notice"] for s in got["spans"]} - {n.phrase for n in licenses.BASE}
        # A notice that takes a word of a base phrase gives way to a short form.
        misspelt = {s["notice"] for s in got["spans"] if s["edits"]}
        assert best <= found and bool(best | misspelt) >= bool(found)
        assert set(got["base_labels"].split(",")) - {""} <= set(got["labels"].split(","))


def test_table(docs, clashing):
    df = clashing(docs([FULL, FULL, None, "", (None, FULL), (7, FULL * 20000)]))
    rows = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert rows[0][1:] == rows[1][1:] == rows[None][1:] and rows[0]["n_base"] == 1
    assert rows[2]["n_words"] == 0 and rows[3]["score"] == 0.0 and rows[2]["first_word"] is None
    assert (rows[7]["n_base"], rows[7]["n_words"], rows[7]["last_word"]) == (20000, 100000, 99996)


def test_empty_table(docs):
    assert licenses.scan_licenses(docs([(1, "x")]).limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, labels",
    [
        ("distributed under the MIT licence", "mit"),
        ("available under the MIT licence", "mit"),
        ("Apache Licence, Version 2.0", "apache-2"),
        ("use under the MIT licens terms", "mit"),
        ("the GNU Generel Public License applies", "gpl"),
        ("under the MPL license", ""),
        ("Apache License, Version 1.1", ""),
    ],
)
def test_misspelt_short_forms(text, labels):
    assert (scan(text)["labels"], scan(text)["n_base"]) == (labels, 0)


def test_a_base_phrase_is_found_once():
    assert [s["edits"] for s in scan("x under the MIT license, under the MIT licence")["spans"]] == [0, 1]


def test_notices_without_edits_are_searched():
    scanner = licenses.Scanner((), (licenses.Notice("isc", "isc license"),), ())
    rows = [scanner.scan(t)[5] for t in ("the ISC License.", "the ISC licence", "misc license")]
    assert rows == ["isc", "", ""]
