"""BPE encoding and decoding by speculation.

Greedy longest match proposes the tokens of a word.  A sequence of tokens is what merging gives exactly if every
adjacent pair of it is: so the pairs of all new words are checked together, against a sorted table of pairs that
grows as merging two tokens' bytes decides new ones.  Only words with a pair that fails are merged step by step.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import PART_CHARS, id_and_text, parts, slices

# Words that a task remembers.
REMEMBERED = 200_000


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for themselves, the others for
    code points from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=1)
def _unassigned() -> regex.Pattern:
    """The characters that Python's tables don't know."""
    ranges, start = [], None
    for c in range(0x110001):
        missing = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if missing and start is None:
            start = c
        elif not missing and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return regex.compile("[" + "".join(ranges) + "]")


def _newer(text: str) -> bool:
    """Whether a text has characters that Unicode has got since.  Whether such a one is a letter differs from one
    library to the other, so these texts are cut into words by the tokenizer's own pattern engine."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _unassigned().search(text) is not None
    return False


class Vocabulary:
    """A byte-level BPE vocabulary with ends of words, from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if not suffix or model.get("continuing_subword_prefix") or spec.get("decoder") or model.get("ignore_merges"):
            raise ValueError("only vocabularies with an end-of-word suffix and without a decoder are supported")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        to_byte, ids = _byte_characters(), model["vocab"]
        self.strings = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.strings[i] = token
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.raw: list[tuple[bytes, bool]] = [(b"", False)] * len(self.strings)
        for token, i in ids.items():
            end = token.endswith(suffix)
            raw = bytes(to_byte[c] for c in (token[: -len(suffix)] if end else token))
            (self.final if end else self.inner)[raw] = i
            self.raw[i] = raw, end
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.base = [self.inner.get(bytes([b])) for b in range(256)], [self.final.get(bytes([b])) for b in range(256)]
        if None in self.base[0] or None in self.base[1]:
            raise ValueError("a byte is not in the vocabulary")
        # Greedy may only propose what merging can reach.
        self.inner = {raw: i for raw, i in self.inner.items() if len(raw) == 1 or self.merge(raw, False) == [i]}
        self.final = {raw: i for raw, i in self.final.items() if len(raw) == 1 or self.merge(raw, True) == [i]}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.codes, self.fits = np.empty(0, np.int64), np.empty(0, bool)

    def merge(self, word: bytes, ends: bool = True) -> list[int]:
        """Step by step: the pair with the lowest rank first, of equal ones the leftmost."""
        symbols = [self.base[0][b] for b in word]
        if ends:
            symbols[-1] = self.base[1][word[-1]]
        n, merges = len(symbols), self.merges
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := merges.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, i, merged = heapq.heappop(heap)
            j = following[i]
            if symbols[i] < 0 or j >= n or merges.get((symbols[i], symbols[j])) != (rank, merged):
                continue
            symbols[i], symbols[j] = merged, -1
            following[i] = k = following[j]
            if k < n:
                previous[k] = i
                if m := merges.get((merged, symbols[k])):
                    heapq.heappush(heap, (m[0], i, m[1]))
            if (h := previous[i]) >= 0 and (m := merges.get((symbols[h], merged))):
                heapq.heappush(heap, (m[0], h, m[1]))
        return [s for s in symbols if s >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        found, at, n = [], 0, len(word)
        inner, final, longest = self.inner, self.final, self.longest
        while at < n:
            end = min(n, at + longest)
            token = final.get(word[at:end]) if end == n else inner.get(word[at:end])
            while token is None:
                end -= 1
                token = inner.get(word[at:end])
            found.append(token)
            at = end
        return found

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens, as left * size + right, are what merging their bytes gives."""
        wanted, back = np.unique(codes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, wanted), max(0, len(self.codes) - 1))
        unknown = wanted[self.codes[at] != wanted] if len(self.codes) else wanted
        if len(unknown):
            size = len(self.strings)
            fits = []
            for left, right in zip((unknown // size).tolist(), (unknown % size).tolist()):
                raw, end = self.raw[right]
                fits.append(self.merge(self.raw[left][0] + raw, end) == [left, right])
            codes, fits = np.concatenate((self.codes, unknown)), np.concatenate((self.fits, fits))
            order = np.argsort(codes)
            self.codes, self.fits = codes[order], fits[order].astype(bool)
        return self.fits[np.searchsorted(self.codes, wanted)][back]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word."""
        raws = [w.encode() for w in words]
        proposed = [self.propose(raw) for raw in raws]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        last = np.cumsum(sizes) - 1
        pairs = np.ones(len(flat), bool)
        pairs[last] = False
        left = np.flatnonzero(pairs)
        wrong = left[~self._fit(flat[left] * len(self.strings) + flat[left + 1])]
        for i in np.unique(np.searchsorted(last, wrong)).tolist():
            proposed[i] = self.merge(raws[i])
        return proposed

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if _newer(text):
            normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
            return [w for w, _ in pre_tokenizers.Split(Regex(self.pattern.pattern), "removed", invert=True).pre_tokenize_str(normal)]
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower-casing goes by single characters, so the end of a word doesn't matter
            text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, and remembers words."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self.known, new = {}, list(words)
        for word, ids in zip(new, self.vocabulary.encode_words(new)):
            self.known[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        held: list[list[list[str] | bytes]] = []
        size = 0
        for text in texts:
            held.append([])
            for part in parts(text):
                for i, piece in enumerate(self._pieces(part)):
                    if i % 2:
                        held[-1].append(np.array([self.vocabulary.special[piece]], "<u4").tobytes())
                    else:
                        held[-1].append(self.vocabulary.words(piece))
                size += len(part)
                if size >= PART_CHARS:
                    yield from self._flush(held[:-1])
                    done = b"".join(self._flush(held[-1:]))
                    held, size = [[done]], 0
        yield from self._flush(held)

    def _pieces(self, text: str) -> list[str]:
        pattern = self.vocabulary.special_pattern
        return pattern.split(text) if pattern and any(s in text for s in self.vocabulary.special) else [text]

    def _flush(self, held: list[list]) -> list[bytes]:
        self._learn({w for text in held for words in text if type(words) is list for w in words})
        known = self.known.__getitem__
        return [b"".join(p if type(p) is bytes else b"".join(map(known, p)) for p in text) for text in held]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, ids (binary, little-endian unsigned 32-bit integers).

    A null or empty text has no ids.  Special tokens inside a text are recognised and none are added.  ``path`` names
    the vocabulary's file on every executor.  Other columns are not read; no shuffle.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(path))
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = pa.array(list(encoder.encode(texts)), pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(work, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the text that the ids stand for: the tokens as they are written in the
    vocabulary, special ones too, with blanks between.  Ids that the vocabulary lacks are left out."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = vocabulary(path).strings
        for batch in slices(batches, "ids", 4 << 20):
            texts = []
            for ids in batch.column("ids"):
                numbers = np.frombuffer(ids.as_buffer() or b"", "<u4") if ids.is_valid else np.empty(0, "<u4")
                known = numbers[numbers < len(strings)].tolist()
                texts.append(" ".join([s for i in known if (s := strings[i])]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.large_string())], names=["doc_id", "ids", "text"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, ids binary, text string")
