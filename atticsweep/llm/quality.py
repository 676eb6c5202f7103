"""Quality rules: a decision list learned from labelled statistics, applied as Spark conditional expressions.

Sequential covering in two steps per rule. Growing adds the threshold condition with
the highest information gain until no good document is covered; pruning, on rows
kept apart, takes conditions off the end while that makes the rule no worse. Rows
that a rule covers are taken away and the next rule is grown on the rest. The
outcome is an ordered list of conjunctions such as ``symbols_per_word >= 0.31 AND
n_words >= 74``, each rejecting what it covers; it becomes one CASE expression over
the statistics columns.

Statistics come from whole texts in one map without a shuffle. Rules are fitted on
at most ``max_rows`` labelled rows, chosen by a hash of the id; only their
statistics reach the driver.

Defined cases: null and empty texts have no words and fail the base rules; rows with
null labels or ids teach nothing; without labels, or without bad ones, the list is
empty and only the base rules reject; repeated rows are judged each; an empty table
gives an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of, texts
from atticsweep.session import written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGIT = b"0123456789"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_marks",
)
# What the rules may look at, from the counts.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
    "digits_per_word": ("n_digits", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "lines_per_word": ("n_lines", "n_words"),
}
FEATURES = ("n_words", *RATIOS, "upper_share")


def count_text(text: str) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    data = text.encode("utf-8")
    words = data.split()  # at the six ASCII white-space characters
    of = lambda chars: len(data) - len(data.translate(None, chars))
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        covered = bytearray(len(words))
        for i, window in enumerate(windows):
            if often[window] > 1:
                covered[i] = covered[i + 1] = covered[i + 2] = 1
        repeated = sum(covered)
    return (
        len(words), len(text) - of(SPACES), of(SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), len(set(words)), of(UPPER), of(LOWER), of(DIGIT), of(b"!?"),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            counted = [count_text(t) for t in rows.column("text").to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*counted, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", *COUNTS])

    return texts(docs).mapInArrow(count, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def with_features(stats: DataFrame) -> DataFrame:
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b).otherwise(0.0)

    shares = {name: ratio(F.col(a), F.col(b)) for name, (a, b) in RATIOS.items()}
    shares["upper_share"] = ratio(F.col("n_upper"), F.col("n_upper") + F.col("n_lower"))
    return stats.withColumns(shares)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy(float)
        return values >= self.threshold if self.at_least else values <= self.threshold

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= F.lit(self.threshold) if self.at_least else value <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects what it covers."""

    conditions: tuple[Condition, ...]

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        return reduce(np.logical_and, [c.holds(rows) for c in self.conditions])

    def column(self) -> Column:
        return reduce(Column.__and__, [c.column() for c in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


def _thresholds(values: np.ndarray, most: int = 200) -> np.ndarray:
    """Middles between neighbouring values, thinned out evenly by rank."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return distinct[:0]
    middles = (distinct[1:] + distinct[:-1]) / 2
    return middles[np.unique(np.linspace(0, len(middles) - 1, min(most, len(middles))).astype(int))]


def _best_condition(rows: pd.DataFrame, bad: np.ndarray) -> tuple[float, Condition | None]:
    """The condition with the highest gain over the rows that the rule covers so far."""
    p0, n0 = bad.sum(), (~bad).sum()
    before, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for feature in FEATURES:
        values = rows[feature].to_numpy(float)
        cuts = _thresholds(values)
        if not len(cuts):
            continue
        order = np.argsort(values, kind="stable")
        below = np.searchsorted(values[order], cuts)  # how many rows lie below each cut
        bad_below = np.concatenate([[0], np.cumsum(bad[order])])[below]
        for at_least in (True, False):
            p = p0 - bad_below if at_least else bad_below
            n = (len(values) - below if at_least else below) - p
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = (float(gain[i]), Condition(feature, at_least, float(cuts[i])))
    return best


def _grow(rows: pd.DataFrame, bad: np.ndarray, most: int) -> Rule | None:
    conditions: list[Condition] = []
    while bad.any() and not bad.all() and len(conditions) < most:
        gain, condition = _best_condition(rows, bad)
        if condition is None:
            break
        conditions.append(condition)
        inside = condition.holds(rows)
        rows, bad = rows[inside], bad[inside]
    return Rule(tuple(conditions)) if conditions else None


def _prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule with the best worth on rows kept apart, and its share of bad rows there."""
    best, worth, share = rule, -2.0, 0.0
    for n in range(1, len(rule.conditions) + 1):
        shorter = Rule(rule.conditions[:n])
        inside = shorter.holds(rows)
        p, q = int(bad[inside].sum()), int((~bad)[inside].sum())
        value = (p - q) / (p + q) if p + q else -1.0
        if value > worth + 1e-9:
            best, worth, share = shorter, value, p / (p + q) if p + q else 0.0
    return best, share


def learn(rows: pd.DataFrame, bad: np.ndarray, least_share: float = 0.7, most_rules: int = 20, most_conditions: int = 4) -> list[Rule]:
    """The decision list, from features and marks of bad rows; two of three rows grow, the third prunes."""
    rules: list[Rule] = []
    rows, bad = rows.reset_index(drop=True), np.asarray(bad, bool)
    apart = np.arange(len(rows)) % 3 == 2
    while len(rules) < most_rules and bad[~apart].any() and (~bad[~apart]).any():
        rule = _grow(rows[~apart], bad[~apart], most_conditions)
        if rule is None:
            break
        if bad[apart].any():
            rule, share = _prune(rule, rows[apart], bad[apart])
        else:
            share = 0.0
        if share < least_share:
            break
        rules.append(rule)
        rest = ~rule.holds(rows)
        rows, bad, apart = rows[rest], bad[rest], apart[rest]
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **settings) -> list[Rule]:
    """A decision list from at most ``max_rows`` labelled rows that pass the base rules."""
    rows = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("label_id"), F.col("quality").cast("int").alias("quality")
    )
    one = rows.groupBy("label_id").agg(F.min("quality").alias("quality"))
    chosen = written(one.orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows))
    # At most max_rows pairs of a long and an int.
    own = texts(docs).join(F.broadcast(chosen.select("label_id")), F.col("doc_id") == F.col("label_id")).drop("label_id")
    known = with_features(statistics(own)).filter(~base_failed())
    points = known.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "quality", *FEATURES)
    points = points.orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES).toPandas()
    return learn(points[list(FEATURES)], points["quality"].to_numpy() == 0, **settings)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row, 0 if none does, as one CASE expression."""
    if not rules:
        return F.lit(0)
    cases = F
    for number, rule in enumerate(rules, 1):
        cases = cases.when(rule.column(), F.lit(number))
    return cases.otherwise(F.lit(0))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, base_failed, kept and the rejecting rule's number for every row."""
    judged = with_features(statistics(docs)).withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    kept = ~F.col("base_failed") & (F.col("rule") == 0)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), "rule",
    )


def quality_rules(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``judge`` by rules fitted on the labelled rows."""
    return judge(docs, fit(docs, labels, **settings))
