"""License scans: notices found in spite of small edits.

A notice that occurs with at most ``k`` edits, cut into ``k + 1`` pieces, leaves one piece unharmed.  One
automaton looks for all pieces of all notices; each find points at a window, and only there does bounded-error
matching decide, which also gives the span and the number of edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ALNUM, id_and_text, records


@dataclass(frozen=True)
class Notice:
    """Words of a notice, joined by single blanks, and the label it stands for.  ``edits``: tolerated edits of
    characters; 0 takes it only at word limits, which is how the base phrases are meant.  ``names``: words that tell the
    notice from others; it is then held to word limits, and a third of each name's characters may be edited."""

    label: str
    phrase: str
    edits: int = 0
    names: tuple[str, ...] = ()


# The base phrases.
BASE = (
    Notice("mit", "under the mit license"),
    Notice("apache-2", "apache license version 2"),
    Notice("cc-by-nc", "cc by nc"),
)
# Short notices as they stand in files and pages, with about one edit per ten characters.
NOTICES = (
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "licensed under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    Notice("apache-2", "licensed under the apache license version 2 0", 4),
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("gpl", "under the terms of the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 4),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("mpl-2", "mozilla public license version 2 0", 3),
    Notice("unlicense", "released into the public domain", 3),
)
# The base phrases and other short forms with one edit per ten characters ("cc by nc" has none); taken where nothing above is.
SHORT = (
    Notice("mit", "under the mit license", 2, ("mit",)),
    Notice("apache-2", "apache license version 2", 2, ("apache", "2")),
    Notice("gpl", "gnu general public license", 2, ("gnu", "general")),
    Notice("bsd", "under the bsd license", 2, ("bsd",)),
)

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()),
                        ("first_word", pa.int64()), ("last_word", pa.int64()),
                        ("start", pa.int64()), ("end", pa.int64()),
                    ]
                )
            ),
        ),
    ]
)
COLUMNS = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
    "labels string, score double, spans array<struct<label:string,notice:string,edits:int,first_word:bigint,"
    "last_word:bigint,start:bigint,end:bigint>>"
)


def _whole(n: Notice) -> bool:
    """Whether a notice is taken only at word limits."""
    return bool(n.names) or not n.edits


def _fewest(n: Notice, found: str) -> int:
    """The edits that a text found for a notice has."""
    phrase = regex.escape(n.phrase.encode().decode("latin-1"))
    return sum(regex.fullmatch(f"(?b)(?:{phrase}){{e<={n.edits}}}", found).fuzzy_counts)


class Scanner:
    """The notices, cut and ready to be looked for.  Texts are seen as blank-joined words with a blank at each end,
    one character per byte."""

    def __init__(
        self, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, short: tuple[Notice, ...] = SHORT
    ):
        self.automaton = ahocorasick.Automaton()
        self.base = [n for n in base]
        self.fuzzy = [*notices, *short]
        self.first_short = len(self.base) + len(notices)
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for i, n in enumerate([*self.base, *self.fuzzy]):
            phrase = n.phrase.encode().decode("latin-1")
            if i < len(self.base):
                phrase = f" {phrase} "
            step = len(phrase) / (n.edits + 1)
            for k in range(n.edits + 1):
                start, end = round(k * step), round((k + 1) * step)
                pieces.setdefault(phrase[start:end], []).append((i, start, len(phrase)))
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()
        self.patterns = [self._pattern(n) for n in self.fuzzy]
        self.empty = not pieces

    @staticmethod
    def _pattern(n: Notice) -> regex.Pattern:
        phrase = f"(?:{regex.escape(n.phrase.encode().decode('latin-1'))})"
        if n.edits:
            phrase += f"{{e<={n.edits}}}"
        return regex.compile("(?e)" + (f"(?<= ){phrase}(?= )" if _whole(n) else phrase))

    @staticmethod
    def _named(n: Notice, found: str) -> bool:
        """Whether all names of a notice are among the words found."""
        return all(any(regex.fullmatch(f"(?:{x}){{e<={len(x) // 3}}}", w) for w in found.split()) for x in n.names)

    def find(self, line: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
        """Base places as (notice, start, end), and fuzzy ones as (notice, start, end, edits), in characters."""
        exact, windows = [], {}
        if self.empty:
            return exact, []
        for at, (size, uses) in self.automaton.iter(line):
            first = at - size + 1
            for i, offset, length in uses:
                if i < len(self.base):
                    exact.append((i, first - offset + 1, first - offset + length - 1))  # one piece: the whole phrase
                else:
                    notice = self.fuzzy[i - len(self.base)]
                    k = notice.edits
                    end = first - offset + length + k + (1 if _whole(notice) else 0)
                    windows.setdefault(i, []).append((max(0, first - offset - k), end))
        return exact, [(i, *hit) for i, found in windows.items() for hit in self._verify(i, line, found)]

    def _verify(self, i: int, line: str, windows: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        notice, pattern, merged = self.fuzzy[i - len(self.base)], self.patterns[i - len(self.base)], []
        for start, end in sorted(windows):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        for start, end in merged:
            while m := pattern.search(line, start, end):
                if not self._named(notice, m[0]):
                    start = m.start() + 1  # another one may begin inside it
                    continue
                # Held to word limits, a match may come with more edits than it needs.
                least = _fewest(notice, m[0]) if notice.names else sum(m.fuzzy_counts)
                yield m.start(), m.end(), least
                start = max(m.end(), start + 1)

    def scan(self, text: str | None) -> tuple:
        """The columns of ``SCHEMA`` after doc_id."""
        words = text.encode().translate(ALNUM).split() if text else []
        line = f" {b' '.join(words).decode('latin-1')} "
        exact, fuzzy = self.find(line)
        if not exact and not fuzzy:
            return len(words), 0, None, None, "", "", 0.0, []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        word_at = lambda i: int(np.searchsorted(blanks, i, "right")) - 1
        starts, ends = _places(text)
        notices, first_fuzzy = [*self.base, *self.fuzzy], len(self.base)
        spans, base_starts, base_labels, best = [], [], set(), 0.0
        for i, start, end, edits in sorted([*((*e, 0) for e in exact), *self._settle(fuzzy, exact)], key=lambda s: s[1:]):
            while line[start] == " " and start < end - 1:
                start += 1
            while line[end - 1] == " " and start < end - 1:
                end -= 1
            a, b = word_at(start), word_at(end - 1)
            if i < first_fuzzy:
                base_starts.append(a)
                base_labels.add(notices[i].label)
            best = max(best, 1 - edits / len(notices[i].phrase))
            spans.append((notices[i].label, notices[i].phrase, edits, a, b, starts[a], ends[b]))
        return (
            len(words), len(base_starts), min(base_starts, default=None), max(base_starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted({s[0] for s in spans})), best,
            [dict(zip(("label", "notice", "edits", "first_word", "last_word", "start", "end"), s)) for s in spans],
        )

    def _settle(
        self, fuzzy: list[tuple[int, int, int, int]], exact: list[tuple[int, int, int]]
    ) -> list[tuple[int, int, int, int]]:
        """Of matches that overlap, the one with the fewest edits for its length; a short form only where neither another
        notice nor a base phrase is, and a notice that cuts a base phrase in two only where no short form is."""
        kept: list[tuple[int, int, int, int]] = []  # by start; they don't overlap
        notice = lambda f: self.fuzzy[f[0] - len(self.base)]
        short = lambda f: f[0] >= self.first_short
        starts = sorted(start for _, start, _ in exact)
        ends = list(accumulate((end for _, _, end in sorted(exact, key=lambda e: e[1])), max))
        # Whether a base phrase that starts before a place goes beyond another one.
        reached = lambda before, beyond: (k := bisect_left(starts, before)) > 0 and ends[k - 1] > beyond
        cuts = lambda f: reached(f[1], f[1]) or reached(f[2], f[2])
        order = lambda f: (cuts(f), short(f), f[3] / len(notice(f).phrase), -len(notice(f).phrase), notice(f).label, f)
        for f in sorted(fuzzy, key=order):
            if short(f) and reached(f[2], f[1]):
                continue
            at = bisect_left(kept, f[1], key=lambda k: k[1])
            if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
                kept.insert(at, f)
        return kept


def _places(text: str) -> tuple[list[int], list[int]]:
    """Where the words of a text start and end, in code points."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(text.encode().translate(ALNUM), np.uint8) != 0x20
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points[edge[::2]].tolist(), points[edge[1::2]].tolist()


def scan_licenses(
    docs: DataFrame, base: tuple[Notice, ...] = BASE, notices: tuple[Notice, ...] = NOTICES, short: tuple[Notice, ...] = SHORT
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): number of words, places of the base phrases, labels, the best
    similarity as score, and every span with its edits, its words and its place in the text in code points.

    Texts are taken whole.  A null or empty text has no words, no labels and score 0; repeated rows and null ids
    are rows like others; other columns of ``docs`` are not read.  No shuffle: each text is scanned where it is read.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, notices, short)
        for batch in batches:
            texts = batch.column("text")
            yield records(
                [(d, *scanner.scan(t.as_py())) for d, t in zip(batch.column("doc_id").to_pylist(), texts)], SCHEMA
            )

    return id_and_text(docs).mapInArrow(work, COLUMNS)
