"""Quality rules: word and line counts, and how a public vocabulary takes a text apart.

Fertility is measured word by word: characters per token, the share of tokens that are single bytes, and the entropy
of the tokens in bits.  Each language, or script where the language isn't known, has its own bands around the
quartiles of all its different texts that pass the base rules: copies of one text, which may be most of a corpus
before it is deduplicated, count once.  In a group of few texts, whose quartiles say little, a text may as well be within
the bands of all.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logquarry.session import settle

from .common import fresh, in_small_batches, named

# Fixed values of the base rules.
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words

# Languages with bands of their own; all others go by script.
LANGUAGES = ("ar", "de", "en", "es", "fr", "hi", "it", "ja", "ko", "nl", "pl", "pt", "ru", "tr", "zh")
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Thai", "Han", "Hiragana",
    "Katakana", "Hangul",
)
# A band reaches this many times from the median to the quartile on its side: 7 is the usual outer fence, three quartile
# ranges beyond the quartile.  Means over few tokens scatter more, so ``chars_per_token`` is judged by its distance from the
# median times the root of the number of tokens.  Each band has a small least width; most groups have no byte tokens at
# all, and a quartile distance of 0 would reject one odd character.
BANDS = {
    "chars_per_token": {"times": 7.0, "least": 0.5, "low": True, "high": True},
    "byte_share": {"times": 7.0, "least": 0.05, "low": False, "high": True},
    "entropy": {"times": 7.0, "least": 0.1, "low": True, "high": False},
}
NOISE = 0.01  # of rounding, added to each band
ALL = "*"  # the group of all texts
LEAST_TEXTS = 20  # different texts of a group that is judged by its own bands alone

REMEMBERED = 200_000  # words that a task remembers
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, "
    "chars_per_token double, byte_share double, entropy double, band_group string"
)


def repeated_words(words: list) -> int:
    """Words inside three-word windows that the text has more than once."""
    if len(words) < 4:
        return 0
    numbers: dict = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(at[:-1] * len(numbers) + at[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(numbers) + at[2:], return_inverse=True, return_counts=True)
    inside = np.zeros(len(words), bool)
    again = np.flatnonzero(count[which] > 1)
    for k in range(3):
        inside[again + k] = True
    return int(inside.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def script_of(text: str) -> str:
    """The script with the most letters; ``none`` without a letter of those known."""
    if text.isascii():
        return "Latin" if regex.search("[A-Za-z]", text) else "none"
    counts = {s: sum(map(len, regex.findall(rf"\p{{Script={s}}}+", text))) for s in SCRIPTS}
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


@lru_cache(maxsize=2)
def _pieces(path: str) -> tuple:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


class Fertility:
    """Tokens of texts by a sentencepiece vocabulary with byte fallback."""

    def __init__(self, path: str):
        self.model, self.is_byte = _pieces(path)
        self.known: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, list(words)
        for word, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            self.known[word] = np.array(ids, np.int32).tobytes()

    def measure(self, words: list[bytes], chars: int) -> tuple[int, float, float, float]:
        """Tokens, characters per token, share of byte tokens, entropy in bits."""
        self._learn(set(words))
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        share = np.unique(ids, return_counts=True)[1] / len(ids)
        return len(ids), chars / len(ids), float(self.is_byte[ids].mean()), float(-(share * np.log2(share)).sum())


def _measure(text: str | None, lang: str | None, fertility: Fertility) -> tuple:
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    group = lang.lower() if lang and lang.lower() in LANGUAGES else f"script:{script_of(text)}"
    return (
        len(words), chars, sum(map(text.count, SYMBOLS)), repeated_lines(text), repeated_words(words),
        *fertility.measure(words, chars), group,
    )


def measures(path: str, text: Column, lang: Column) -> Column:
    """The counts and the fertility of a text, as a struct ``MEASURES``."""

    @F.pandas_udf(MEASURES)
    def of(texts: pd.Series, langs: pd.Series) -> pd.DataFrame:
        fertility = Fertility(path)
        rows = [_measure(t, x, fertility) for t, x in zip(texts, langs)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return of(text, lang)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def _value(measured: Column, name: str, middle: Column) -> Column:
    """What the band of a measure is held against."""
    if name != "chars_per_token":
        return F.round(measured[name], 3)
    return F.round((measured[name] - middle) * F.sqrt(measured["n_tokens"]), 2)


def _quartiles(rows: DataFrame, values: list[Column]) -> DataFrame:
    """band_group, measure, q, n: exact quartiles, and the number of values, from counts of (measure, value) structs of each row."""
    counted = rows.select("band_group", F.inline(F.array(*values))).groupBy("band_group", "measure", "value")
    return counted.agg(F.count(F.lit(1)).alias("n")).groupBy("band_group", "measure").agg(
        F.expr("percentile(value, array(0.25D, 0.5D, 0.75D), n)").alias("q"), F.sum("n").alias("n")
    )


def bands(measured: Column, text_hash: Column, rows: DataFrame) -> DataFrame:
    """band_group, texts (different ones), middle (the median of ``chars_per_token``) and, for each measure, the lowest and
    highest ``_value`` that is kept: at most a row per language and script, and one for ``ALL``.  Quartiles are taken from
    counts of rounded values, over all different texts that pass the base rules."""
    good = rows.where(~base_failed(measured)).select(
        measured["band_group"].alias("band_group"), text_hash.alias("text_hash"),
        F.struct(*[measured[k].alias(k) for k in (*BANDS, "n_tokens")]).alias("m"),
    )
    different = good.groupBy("band_group", "text_hash").agg(F.first("m").alias("m"))
    good = settle(different.select(F.explode(F.array("band_group", F.lit(ALL))).alias("band_group"), "m"), "different")
    pair = lambda k, value: F.struct(F.lit(k).alias("measure"), value.alias("value"))
    middles = _quartiles(good, [pair("chars_per_token", F.round(F.col("m.chars_per_token"), 3))])
    middles = middles.select(F.col("band_group").alias("own_group"), F.col("q")[1].alias("middle"), F.col("n").alias("texts"))
    placed = good.join(F.broadcast(middles), F.col("band_group") == F.col("own_group"))
    quartiles = _quartiles(placed, [pair(k, _value(F.col("m"), k, F.col("middle"))) for k in BANDS])
    limits = []
    for name, band in BANDS.items():
        middle, least = F.col("q")[1], F.lit(band["least"])
        low = middle - F.greatest(F.lit(band["times"]) * (middle - F.col("q")[0]), least) - NOISE
        high = middle + F.greatest(F.lit(band["times"]) * (F.col("q")[2] - middle), least) + NOISE
        here = F.col("measure") == name
        limits.append(F.max(F.when(here, low if band["low"] else F.lit(float("-inf")))).alias(f"{name}_low"))
        limits.append(F.max(F.when(here, high if band["high"] else F.lit(float("inf")))).alias(f"{name}_high"))
    return quartiles.groupBy("band_group").agg(*limits).join(
        F.broadcast(middles), F.col("band_group") == F.col("own_group")).drop("own_group")


def _judged(rows: DataFrame, m: str, text_hash: str, verdict: str) -> DataFrame:
    """``rows``, whose column ``m`` holds measures, with the verdict whether they are kept."""
    measured, name = named(rows, m), fresh(rows, "limits")
    limits = bands(measured, named(rows, text_hash), rows)
    found = {r["band_group"]: r for r in limits.collect()}  # a row per language and script
    both = [(g, tuple(r), tuple(found[ALL])) for g, r in found.items() if g != ALL]
    schema = T.StructType().add("of_group", T.StringType()).add("own", limits.schema).add("all", limits.schema)
    chosen = rows.sparkSession.createDataFrame(both, schema).select(F.struct("*").alias(name))
    own = F.col(f"`{name}`")

    def inside(band: Column) -> Column:
        out = F.lit(True)
        for k in BANDS:
            out &= _value(measured, k, band["middle"]).between(band[f"{k}_low"], band[f"{k}_high"])
        return out

    inside = inside(own["own"]) | ((own["own"]["texts"] < LEAST_TEXTS) & inside(own["all"]))
    joined = rows.join(F.broadcast(chosen), measured["band_group"] == own["of_group"], "left")
    return joined.withColumn(verdict, ~base_failed(measured) & F.coalesce(inside, F.lit(False))).drop(name)


def _lang(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def judge(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, and lang if it has one): doc_id, the measures, base_failed, kept.

    A null, empty or blank text has no words, so it fails.  Repeated rows are rows like others; a null or unknown
    language goes by script.  ``path`` names the vocabulary's file on every executor.  Texts are measured once; the
    measures are staged, counted for the bands, and judged.
    """
    rows = in_small_batches(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"),
        measures(path, F.col("text"), _lang(docs)).alias("m"),
    )
    rows = settle(rows, "measures")
    judged = _judged(rows, "m", "text_hash", "kept")
    return judged.select("doc_id", "m.*", base_failed(F.col("m")).alias("base_failed"), "kept")


def keep_good(docs: DataFrame, path: str) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    m, verdict, text_hash = fresh(docs, "measures"), fresh(docs, "verdict"), fresh(docs, "text_hash")
    measured = in_small_batches(docs).withColumn(m, measures(path, F.col("text"), _lang(docs)))
    rows = settle(measured.withColumn(text_hash, F.xxhash64("text")), "measured")
    return _judged(rows, m, text_hash, verdict).where(f"`{verdict}`").drop(m, verdict, text_hash)
