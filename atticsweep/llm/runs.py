"""Periodic runs of words: stretches that repeat one period three times or more.

A run that counts is a longest stretch of smallest period q with at least ``least``
words and ``times`` periods. Each of its words occurs ``times`` times in it, so a
segment's words that occur less often there are in no run and split the segment; the
pieces are counted anew, until nothing splits or the piece is too short. All segments
of a slice of texts are split together, with numbers for words.

Surviving segments are scanned at lags: where words ``lag`` apart are the same over a
stretch, that stretch and the ``lag`` words behind it have period ``lag``. The lags worth
scanning come from equal grams: a gram of 2^k words that meets itself again first ``lag``
words later, with 2^(k-1) < lag <= 2^k. Every run has such a gram at its beginning: words
equal to those a period later last for at least 2^k words, and an earlier meeting would
make the period smaller (two periods in a stretch as long as both have their divisor as
period as well). So no run is missed, long texts cost n log n for the grams, and scans
only where something repeats.

Rows are judged where they are: no shuffle; one task's memory holds a slice of rows.

Defined cases: a null or empty text, or one of white space, has no words and no runs; a
null id counts as the empty text where an id is used; texts may be of any length, memory
follows the longest; repeated rows give repeated results; an empty table gives an empty
one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from atticsweep.llm.common import rows_of, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SLICE = 8 << 20
Run = tuple[int, int, int]  # start, length, period


def split_segments(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int]]:
    """What is left of the segments [start, end) when words too rare in their segment have split them, again and again."""
    done: list[tuple[int, int]] = []
    while True:
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sorted(done)
        sizes = ends - starts
        segment = np.repeat(np.arange(len(starts)), sizes)
        at = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        # One number for (segment, word): how often does it occur?
        _, inverse, count = np.unique(segment * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        rare = count[inverse] < times
        stable = np.bincount(segment, rare, len(starts)) == 0
        done += zip(starts[stable].tolist(), ends[stable].tolist(), strict=True)
        open_ = ~stable[segment]
        at, segment, rare = at[open_], segment[open_], rare[open_]
        # Pieces begin at a segment's beginning or behind a rare word, and end likewise.
        cut = np.concatenate([[True], (segment[1:] != segment[:-1]) | rare[:-1] | rare[1:]]) if len(at) else np.empty(0, bool)
        first = np.flatnonzero(cut)
        last = np.append(first[1:], len(at))
        kept = ~rare[first]
        starts, ends = at[first[kept]], at[last[kept] - 1] + 1


def lags_of(ids: np.ndarray, least: int = 24, times: int = 3) -> dict[int, np.ndarray]:
    """Lags at which a gram first meets itself again, each with the positions where."""
    found: dict[int, np.ndarray] = {}
    n, size = len(ids), 1
    # A stretch of words equal to those a period later has at least so many words; see the module's text.
    smallest = 1 << max(0, (least - least // times).bit_length() - 1)
    at, gram = np.arange(n), np.unique(ids, return_inverse=True)[1]  # positions, and a number for the gram at each
    while len(at) and size <= n:
        if size >= smallest:
            order = np.argsort(gram, kind="stable")
            same = gram[order][1:] == gram[order][:-1]
            here, lag = at[order][:-1][same], (at[order][1:] - at[order][:-1])[same]
            fits = (lag <= size) & ((lag > size // 2) | (size == smallest))
            for q in np.unique(lag[fits]).tolist():
                found[q] = np.sort(here[fits & (lag == q)])
        # The gram of twice the size: this gram and the one behind it. One that occurs once cannot repeat when longer.
        often = np.bincount(gram)[gram] > 1
        at, gram = at[often], gram[often]
        where = np.searchsorted(at, at + size)
        there = where < len(at)
        there[there] = at[where[there]] == at[there] + size
        pair = gram[there].astype(np.int64) * (int(gram.max(initial=0)) + 1) + gram[where[there]]
        at, gram = at[there], np.unique(pair, return_inverse=True)[1]
        size *= 2
    return found


def scan(ids: np.ndarray, least: int = 24, times: int = 3) -> list[Run]:
    """The runs of a segment, by comparing it with itself at the lags worth it."""
    runs: list[Run] = []
    for lag, meets in lags_of(ids, least, times).items():
        same = np.concatenate([[False], ids[:-lag] == ids[lag:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        starts, lengths = edges[::2], edges[1::2] - edges[::2] + lag
        enough = lengths >= max(least, times * lag)
        # Only where the lag is the smallest period does a gram meet itself first after ``lag`` words.
        where = np.searchsorted(meets, starts)
        own = np.append(meets, -1)[where] == starts
        runs += [(s, n, lag) for s, n in zip(starts[enough & own].tolist(), lengths[enough & own].tolist(), strict=True)]
    return runs


def find_runs(documents: list[list[str]], least: int = 24, times: int = 3) -> list[list[Run]]:
    """The runs of each list of words, by start, then period. Three periods at least: with two, a gram need not meet itself."""
    if times < 3:
        raise ValueError("times is 3 or more")
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in documents for w in words), np.int64)
    ends = np.cumsum([len(words) for words in documents], dtype=np.int64)
    starts = np.concatenate([[0], ends])[:-1]
    out: list[list[Run]] = [[] for _ in documents]
    for a, b in split_segments(ids, starts, ends, least, times) if len(ids) else []:
        i = int(np.searchsorted(ends, a, side="right"))
        out[i] += [(a + s - int(starts[i]), n, q) for s, n, q in scan(ids[a:b], least, times)]
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run contains behind its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of most periods, fractions counted; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """A tenth of the documents, by the CRC-32 of the id, with their tail made periodic."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // len(tail))))[: n - a]


def _run_rows(docs: DataFrame, least: int, times: int, row, names: list[str], kinds: list[pa.DataType], plant: bool) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches, SLICE):
            ids = rows.column("doc_id").to_pylist()
            words = [WORD.findall(text) for text in rows.column("text").to_pylist()]
            if plant:
                words = [planted(i, w) for i, w in zip(ids, words, strict=True)]
            out = [row(w, found) for w, found in zip(words, find_runs(words, least, times), strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names=["doc_id", *names])

    spark_kinds = {pa.int64(): "bigint", pa.string(): "string"}
    schema = ["doc_id bigint"]
    for name, kind in zip(names, kinds, strict=True):
        schema.append(f"{name} " + spark_kinds.get(kind, "array<struct<start: bigint, length: bigint, period: bigint>>"))
    return texts(docs).mapInArrow(judge, ", ".join(schema))


def without_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row: doc_id, the text's kept words joined by one space, and its runs."""
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def row(words: list[str], found: list[Run]):
        return " ".join(collapsed(words, found)), [dict(zip(("start", "length", "period"), r, strict=True)) for r in found]

    return _run_rows(docs, least, times, row, ["text", "runs"], [pa.string(), run], plant=False)


def run_digests(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Per row with a tenth of the texts planted: n_runs, the strongest run, and digests of all runs and of the kept words."""

    def row(words: list[str], found: list[Run]):
        best = strongest(found)
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, " ".join(collapsed(words, found))))
        return len(found), *facts, *digests

    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return _run_rows(docs, least, times, row, names, [pa.int64()] * 5 + [pa.string()] * 2, plant=True)
