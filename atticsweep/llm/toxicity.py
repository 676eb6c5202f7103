"""Toxicity by a weighted lexicon that Aho-Corasick finds in folded text.

Folding lower-cases, takes accents off, and turns look-alike letters and digits into
the letters they stand for. The lexicon holds whole words and word beginnings, each
weighted by how much more frequent it is in toxic than in other documents. Every
word counts once, with its heaviest term, unless an exception phrase covers it; the
sum is divided by a slowly growing function of the length, and a logistic curve
fitted on the same rows turns it into a probability.

The lexicon is fitted on at most ``max_rows`` labelled rows, chosen by a hash of the
id; scoring is a map over whole texts without a shuffle. What goes to the tasks is
the lexicon: terms found in at least ``least_share`` of the toxic rows, so its size
is bounded by the bound on the rows.

Defined cases: null and empty texts score the base rate; rows without a label, with
a null label or null id teach nothing; a repeated labelled row counts once per text;
without toxic rows all documents get the base rate (0 without labels); an empty
table gives an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import remainder, rows_of, texts
from atticsweep.session import written

# Letters that look like Latin ones, by the Latin one. Accents and full-width forms go by decomposition.
LOOKALIKES = {
    "a": "аαɑ", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іıι", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "м", "n": "пո", "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ν",
    "w": "ԝω", "x": "хχ", "y": "уγ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
FOLD = str.maketrans(
    {ch: latin for latin, chars in LOOKALIKES.items() for ch in chars}
    | DIGITS
    | dict.fromkeys(map(chr, (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
)
MARKS = re.compile("[̀-ͯ]+")
SIGN = re.compile(r"[@$!](?=[^\W_])")
BREAKS = re.compile(r"[\W_]+")
SHORTEST, LONGEST = 4, 8  # letters in a word beginning of the lexicon


def fold(text: str) -> str:
    """Folded words with one space before, between and after."""
    if not text.isascii():
        text = MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.lower().translate(FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {BREAKS.sub(' ', text).strip()} "


def terms_of(folded: str) -> set[str]:
    """The whole words of a folded text, as `` word ``, and their beginnings, as `` wor``."""
    found = set()
    for word in set(folded.split()):
        found.add(f" {word} ")
        found.update(f" {word[:n]}" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))
    return found


@dataclass
class Lexicon:
    """Weights of terms, phrases that excuse the words they cover, and the fitted curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    intercept: float = -30.0
    slope: float = 0.0

    def automaton(self):
        words = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            words.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            words.add_word(phrase, (len(phrase), None))
        if len(words):
            words.make_automaton()
        return words

    def amount(self, folded: str, automaton) -> float:
        """The weights of the words found, by length."""
        if not len(automaton):
            return 0.0
        heaviest: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight is None:
                excused.append((start, end))
            elif folded[end] != " " and folded[end + 1] == " ":
                continue  # a beginning stands for longer words only; the whole word is a term of its own
            elif weight > heaviest.get(start, 0.0):
                heaviest[start] = weight
        if not heaviest:
            return 0.0
        for first, last in excused:
            for start in [s for s in heaviest if first <= s < last]:
                del heaviest[start]
        return sum(heaviest.values()) / (1 + math.log1p(folded.count(" ")) / 8)

    def probability(self, amounts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.log1p(amounts))))


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """Texts and labels of at most ``max_rows`` rows, those with the smallest hashes; one row per text."""
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("label_id"), F.col("toxic").cast("int").alias("toxic")
    )
    taught = rows.filter(remainder(F.col("label_id"), 4) != 2)
    chosen = taught.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    chosen = written(chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    # At most max_rows pairs of a long and an int.
    own = texts(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    return own.groupBy(F.sha2("text", 256).alias("sha")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for rows in rows_of(batches):
        for text, toxic in zip(rows.column("text").to_pylist(), rows.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms_of(fold(text)))
    for toxic, found in counts.items():
        yield _pairs(found, toxic)


def _pairs(found: Counter, toxic: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(found.keys(), pa.string()), pa.array([toxic] * len(found), pa.int32()), pa.array(found.values(), pa.int64())],
        names=["term", "toxic", "n"],
    )


def _phrases_of(folded: str, automaton) -> set[str]:
    """Each word found with the one before and the one after it."""
    found = set()
    for end, (length, _) in automaton.iter(folded):
        if folded[end] != " " and folded[end + 1] == " ":
            continue
        start = end - length + 1
        stop = folded.index(" ", start + 1)
        before = folded.rfind(" ", 0, start)
        after = folded.find(" ", stop + 1)
        if before >= 0 and start > 0:
            found.add(folded[before : stop + 1])
        if after >= 0:
            found.add(folded[start : after + 1])
    return found


def _by_label(counted: DataFrame) -> DataFrame:
    return counted.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"),
    )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, least_share: float = 0.015, odds: float = 8.0) -> Lexicon:
    """The lexicon, its exceptions and its curve, from labelled rows whose crc32 modulo 4 is not 2."""
    rows = written(labelled(docs, labels, max_rows))
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_bad, n_good = size.get(1, 0), size.get(0, 0)
    base = Lexicon(intercept=math.log((n_bad + 1e-9) / (n_good + 1.0)))
    if not n_bad:
        return base
    least = max(2, math.ceil(least_share * n_bad))
    ratio = (F.col("bad") + 0.5) / (n_bad + 1) / ((F.col("good") + 0.5) / (n_good + 1))
    counted = _by_label(rows.mapInArrow(_terms, "term string, toxic int, n bigint"))
    found = counted.filter((F.col("bad") >= least) & (ratio >= odds)).withColumn("weight", F.log(ratio)).collect()
    base.weights = {r["term"]: r["weight"] for r in found}
    if not base.weights:
        return base

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, counts = base.automaton(), {0: Counter(), 1: Counter()}
        for part in rows_of(batches):
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                counts[toxic].update(_phrases_of(fold(text), automaton))
        for toxic, n in counts.items():
            yield _pairs(n, toxic)

    # Phrases in as many other documents as a term needs toxic ones, and hardly in toxic ones.
    harmless = _by_label(rows.mapInArrow(phrases, "term string, toxic int, n bigint"))
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    kept = harmless.filter((F.col("good") >= max(3, math.ceil(least_share / 10 * n_good))) & (share <= 0.02)).collect()
    base.exceptions = [r["term"] for r in kept]

    def amounts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = base.automaton()
        for part in rows_of(batches):
            x = [base.amount(fold(t), automaton) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), part.column("toxic")], names=["x", "toxic"])

    points = rows.mapInArrow(amounts, "x double, toxic int").toPandas()  # max_rows pairs at most
    base.intercept, base.slope = _logistic(np.log1p(points["x"].to_numpy()), points["toxic"].to_numpy(float))
    return base


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a small ridge that keeps separable cases finite."""
    order = np.argsort(x, kind="stable")  # the same sums whatever order the rows came in
    x, y = x[order], y[order]
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p)
        up, right = (y - p).sum() - ridge * a, ((y - p) * x).sum() - ridge * b
        aa, ab, bb = w.sum() + ridge, (w * x).sum(), (w * x * x).sum() + ridge
        det = aa * bb - ab * ab
        a += float(np.clip((bb * up - ab * right) / det, -3, 3))
        b += float(np.clip((aa * right - ab * up) / det, -3, 3))
    return a, max(0.0, b)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for rows in rows_of(batches):
            x = np.array([lexicon.amount(fold(t), automaton) for t in rows.column("text").to_pylist()])
            p = lexicon.probability(x)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs).mapInArrow(judge, "doc_id bigint, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``score`` with a lexicon fitted on the labelled rows, and which rows were held out."""
    scored = score(docs, fit(docs, labels, **settings))
    held_out = remainder(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold."""
    schema = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for rows in rows_of(batches):
            column = rows.column(rows.schema.names.index("text"))
            x = np.array([lexicon.amount(fold(t or ""), automaton) for t in column.to_pylist()])
            yield rows.filter(pa.array(lexicon.probability(x) < threshold))

    return docs.mapInArrow(keep, schema)
