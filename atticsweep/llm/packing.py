"""Packing of tokenized documents by column generation for the cutting-stock problem.

A document is cut into full sequences and one remainder. The histogram of remainder
lengths (at most one number per length) goes to the driver, where a linear program
over patterns - multisets of lengths that fit a sequence - is solved: the simplex
method prices new columns by dynamic programming for the knapsack over the dual
values, until the bound on what is still to gain is below ``gap``. Pattern counts are
rounded down; what remains of the histogram is packed first-fit by decreasing length.

Documents of one length are interchangeable. Each gets a rank among its length, and
rank intervals of a length belong to patterns, so a piece finds its sequence and
offset by itself. Ranks come from counts per (length, salt) and row numbers inside
them: a length shared by a third of all documents is spread over all salts. Texts
are read once and never shuffled; only facts about pieces are.

Defined cases: null and empty texts are the end id alone; very long texts become many
pieces; rows with equal ids are packed each; an empty table gives an empty one; other
columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of, spread_parts, texts
from atticsweep.session import written

END_ID = 1
END_OF_TEXT = "<|endoftext|>"
# Scripts whose letters, digits and spaces no Unicode version has changed for long: here
# the rank form of the tokenizer gives the same ids as its library, several times faster.
SETTLED = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏͰ-ͷͺ-ͿΑ-ΡΣ-ӿ"
                     "‐-‧‰-⁞€ぁ-ゖ一-龥]")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Tokenizer:
    """Token ids of texts as the tokenizers library gives them."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(
            "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={END_OF_TEXT: len(merges)}
        )
        self.path, self.slow = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), None

    def ids(self, text: str) -> np.ndarray:
        if text.isascii() or not SETTLED.search(text):
            if END_OF_TEXT in text:
                return np.array(self.fast.encode(text, allowed_special="all"), dtype="<u4")
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        if self.slow is None:
            from tokenizers import Tokenizer as Library

            self.slow = Library.from_file(self.path)
            self.slow.no_padding()
            self.slow.no_truncation()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def pieces(docs: DataFrame, size: int = 2048, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Every document's ids and an end id, cut at multiples of ``size``: where each piece starts, its length and CRC-32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for rows in rows_of(batches):
            tokenizer = tokenizer or Tokenizer(vocabulary, ranks)
            out: list[tuple] = []
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                ids = np.append(tokenizer.ids(text), np.uint32(END_ID)).astype("<u4")
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            names = [f.split()[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return texts(docs).mapInArrow(cut, PIECES)


# The linear program ---------------------------------------------------------


def greedy_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Patterns (one per column), their inverse, and fractional counts that meet the demand exactly.

    Each pattern takes the longest open lengths that fit, and runs until one of them
    is used up. That length is in no later pattern: with rows in the order of use, the columns are triangular.

    The inverse is by substitution and the products below are by plain sums: threaded
    linear algebra libraries can lock up in a process that has started a JVM.
    """
    n = len(lengths)
    basis, count = np.zeros((n, n)), np.zeros(n)
    left, open_ = demand.astype(float).copy(), list(range(n))  # lengths ascend
    order: list[int] = []
    done = 0
    while open_:
        sizes = [int(lengths[i]) for i in open_]
        room, pattern, at = size, {}, len(open_)
        while at and room >= sizes[0]:
            at = min(at, bisect_right(sizes, room)) - 1
            if at < 0:
                break
            pattern[open_[at]] = room // sizes[at]
            room -= pattern[open_[at]] * sizes[at]
        runs = min(left[i] / k for i, k in pattern.items())
        for i, k in pattern.items():
            basis[i, done] = k
            left[i] -= runs * k
        count[done] = runs
        done += 1
        used = [i for i in pattern if left[i] <= 1e-9 * demand[i]]
        order += used
        for i in used[1:]:  # used up together: a pattern of its own that does not run
            basis[i, done] = size // lengths[i]
            done += 1
        gone = set(used)
        open_ = [i for i in open_ if i not in gone]
    lower, upside = basis[order], np.zeros((n, n))
    for t in range(n):
        before = np.flatnonzero(lower[t, :t])
        row = -(lower[t, before, None] * upside[before]).sum(axis=0)
        row[t] += 1
        upside[t] = row / lower[t, t]
    inverse = np.empty((n, n))
    inverse[:, order] = upside
    return basis, inverse, count


def knapsack(lengths: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern, by dynamic programming over the room left."""
    best, choice = np.zeros(size + 1), np.full(size + 1, -1)
    useful = np.flatnonzero(values > 1e-12)
    sizes, worth = lengths[useful], values[useful]
    ends = np.searchsorted(sizes, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        best[room], choice[room] = best[room - 1], -1
        if ends[room]:
            total = best[room - sizes[: ends[room]]] + worth[: ends[room]]
            i = int(np.argmax(total))
            if total[i] > best[room]:
                best[room], choice[room] = total[i], i
    pattern, room = np.zeros(len(lengths)), size
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[useful[choice[room]]] += 1
            room -= int(sizes[choice[room]])
    return float(best[size]), pattern


def column_generation(
    lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, most_pivots: int = 150
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their fractional counts, within ``gap`` of a lower bound or after ``most_pivots`` changes.

    The bounds are the tokens by the size, and the count of now by the best column's price.
    """
    basis, inverse, count = greedy_basis(lengths, demand, size)
    fewest = float((lengths * demand).sum()) / size
    for _ in range(most_pivots):
        if count.sum() <= (1 + gap) * fewest:
            break
        duals = inverse.sum(axis=0)
        price, pattern = knapsack(lengths, duals, size)
        if price <= 1 + gap:  # the fewest sequences are at least those of now, divided by the price
            break
        inside = np.flatnonzero(pattern)
        direction = (inverse[:, inside] * pattern[inside]).sum(axis=1)
        rising = direction > 1e-9
        if not rising.any():
            break
        ratio = np.full(len(count), np.inf)
        ratio[rising] = np.maximum(count[rising], 0) / direction[rising]
        out = int(np.argmin(ratio))
        step = ratio[out]
        count -= step * direction
        count[out] = step
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= direction[:, None] * row
        inverse[out] = row
    return basis, np.maximum(count, 0)


@dataclass
class Plan:
    """Where the ranks of each length go: interval starts, and what each interval is in."""

    starts: dict[int, np.ndarray]
    facts: dict[int, np.ndarray]  # rows: first sequence, copies of the length in the pattern, offset of the first
    sequences: int

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.starts[length], ranks, side="right") - 1
        first, copies, offset = self.facts[length][i].T
        within = ranks - self.starts[length][i]
        return first + within // copies, offset + within % copies * length


def plan(histogram: dict[int, int], size: int = 2048, **settings) -> Plan:
    """Rounded patterns for a histogram of lengths."""
    full = histogram.get(size, 0)
    lengths = np.array(sorted(x for x in histogram if x < size), dtype=np.int64)
    demand = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    rounded: list[tuple[dict[int, int], int]] = []
    if len(lengths):
        basis, count = column_generation(lengths, demand, size, **settings)
        runs = np.floor(count + 1e-6).astype(np.int64)
        whole = np.rint(basis).astype(np.int64)
        for j in np.argsort(-runs, kind="stable"):
            # Rounding in the last digits must not take more than there is.
            inside = np.flatnonzero(whole[:, j])
            times = int(min(runs[j], (demand[inside] // whole[inside, j]).min())) if len(inside) else 0
            if times > 0:
                demand = demand - times * whole[:, j]
                rounded.append(({int(lengths[i]): int(whole[i, j]) for i in inside}, times))
        rounded += _first_fit(lengths, demand, size)
    if full:
        rounded.append(({size: 1}, full))
    starts: dict[int, list[int]] = {}
    facts: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in rounded:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            starts.setdefault(length, []).append(taken.get(length, 0))
            facts.setdefault(length, []).append((sequence, copies, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return Plan(
        {k: np.array(v, dtype=np.int64) for k, v in starts.items()},
        {k: np.array(v, dtype=np.int64) for k, v in facts.items()},
        sequence,
    )


def _first_fit(lengths: np.ndarray, demand: np.ndarray, size: int) -> list[tuple[dict[int, int], int]]:
    """What rounding left over: first-fit by decreasing length. At most a pattern's worth for each length."""
    room: list[int] = []
    bins: list[dict[int, int]] = []
    for length, n in zip(lengths[::-1].tolist(), demand[::-1].tolist(), strict=True):
        first = 0
        for _ in range(n):
            while first < len(room) and room[first] < length:
                first += 1
            if first == len(room):
                room.append(size)
                bins.append({})
            room[first] -= length
            bins[first][length] = bins[first].get(length, 0) + 1
    return [(b, 1) for b in bins]


def pack(docs: DataFrame, size: int = 2048, vocabulary: str | None = None, ranks: str | None = None, **settings) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    spark = docs.sparkSession
    cut = written(pieces(docs, size, vocabulary, ranks))
    # One row per length: never more than ``size``.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = plan(histogram, size, **settings)
    salts = spread_parts(spark, sum(histogram.values()), 200_000)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    of = ["length", "salt"]
    counts = salted.groupBy(*of).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = written(counts.select(*of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    number = F.row_number().over(Window.partitionBy(*of).orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    numbered = salted.withColumn("number", number - 1)
    ranked = numbered.join(firsts.hint("merge"), of).withColumn("rank", F.col("before") + F.col("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length, rank = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                inside = np.flatnonzero(length == one)
                sequence[inside], offset[inside] = found.place(int(one), rank[inside])
            out = [rows.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    facts = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return facts.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def padding(packed: DataFrame, size: int = 2048) -> DataFrame:
    """Sequences, tokens and padding: to ``size``, except where a sequence's length is a power of two."""
    one = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"))
    power = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    pad = F.when(power, 0).otherwise(F.lit(size) - F.col("tokens"))
    return one.agg(F.count(F.lit(1)).alias("sequences"), F.sum("tokens").alias("tokens"), F.sum(pad).alias("padding"))
