"""Scoring of texts by context-tree weighting over bytes, beside a smoothed word model.

A text is read as its words in lower case, one space between, and an end byte. Each
byte is eight binary decisions; for every decision and every context of up to
``depth`` bytes there is a node with counts n0 and n1, and the Krichevsky-Trofimov
estimate P_e of them. A node's weighted probability mixes its own estimate with the
product of its children's, P_w = (P_e + prod P_w(child)) / 2; what a node adds to a
prediction is its share of that mixture, so estimates of all depths are mixed.

Everything is counted and nothing that was counted is left out: a node visited by
training bytes twice is used, at any size of the input, and what is learned grows with
it. Nodes visited once act as their parents' leaves. No task holds the model:

1. each slice of rows sends its distinct byte runs and words, with their counts in
   training texts, to their parts; the part of a run follows from the context bytes
   next to the byte, so that all deeper contexts meet there;
2. parts add up the counts and answer the slices' words with them; of runs they build
   their trees bottom-up, and pass on the nodes of their topmost depth, from which the
   few depths above are built;
3. each slice asks the parts for its distinct runs, and gets back their log
   probabilities; with them and the words' counts it scores its texts.

What goes to disk between these steps is squeezed where it is made: a slice's texts,
and the codes, counts and answers of each of its parts.

Defined cases: null and empty texts are the end alone; without training rows every
decision has probability one half; rows with a null id count the empty text as id;
repeated rows are scored each and count each; an empty table gives an empty one;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import remainder, rows_of, spread_parts, texts
from atticsweep.session import written

END = b"\n"  # in no word
LOG2 = float(np.log(2.0))
SLICE = 16 << 20  # bytes of text whose distinct runs and words are asked for once
CHUNK = 2 << 20  # of them, those whose runs are in memory one by one
LEAST = 2  # visits of a node that is used
TOP = 3  # context bytes that a part of the tree has in common
PART, WORD_PART = 8 << 20, 32 << 20  # bytes of text for each part
KINDS = "kind int, part bigint, slice bigint, a binary, b binary, c binary, d binary, e binary"
PARTS = "kind int, part bigint, slice bigint, a binary, b binary"


def normal_bytes(text: str) -> tuple[list[bytes], bytes]:
    """The words, and the bytes that are scored."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    return words, b" ".join(words) + END


def byte_runs(streams: list[bytes], depth: int) -> np.ndarray:
    """For each byte of each stream: itself in the lowest eight bits, the ``depth`` bytes before it above.

    Before a text begins there are end bytes.
    """
    data = np.frombuffer(END * depth + (END * (depth - 1)).join(streams) if depth else b"".join(streams), np.uint8)
    runs = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        runs <<= np.uint64(8)
        runs |= data[i : len(data) - depth + i]
    if depth > 1:
        # Between streams stand depth - 1 more end bytes: those are no part of any text.
        sizes = np.array([len(s) for s in streams])
        inside = np.ones(len(runs), bool)
        ends = np.cumsum(sizes + depth - 1) - (depth - 1)
        for i in range(depth - 1):
            inside[(ends + i)[:-1]] = False
        runs = runs[inside]
    return runs


def _counted(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    firsts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[firsts], np.add.reduceat(counts, firsts) if len(firsts) else counts[:0]


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after moving the argument up by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


TABLE = np.arange(1 << 14)
HALF, WHOLE = _log_gamma(TABLE + 0.5), _log_gamma(TABLE + 1.0)  # of most counts


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n = n0 + n1
    at = np.minimum(n, len(TABLE) - 1).astype(np.int64)
    i, j = np.minimum(n0, at).astype(np.int64), np.minimum(n1, at).astype(np.int64)
    out = HALF[i] + HALF[j] - WHOLE[at] - 2 * HALF[0]
    big = np.flatnonzero(n >= len(TABLE))
    out[big] = _log_gamma(n0[big] + 0.5) + _log_gamma(n1[big] + 0.5) - _log_gamma(n[big] + 1.0) - 2 * HALF[0]
    return out


def squeezed(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on, by zstd; in front the number of them."""
    data = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def values_of(data: bytes, kind: type) -> np.ndarray:
    """The array that was squeezed."""
    size = int.from_bytes(data[:8], "little")
    plain = pa.Codec("zstd").decompress(memoryview(data)[8:], size, asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(codes: np.ndarray) -> bytes:
    """Ascending codes as differences: their upper bytes squeeze well."""
    return squeezed(np.diff(codes.astype(np.uint64), prepend=np.uint64(0)))


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(values_of(data, np.uint64), dtype=np.uint64)


@dataclass
class Nodes:
    """The nodes of one depth and one of the eight decisions, in the order of the depth's contexts and bytes."""

    of: np.ndarray  # per context and byte: its node
    first: np.ndarray  # per node: its first context and byte
    n0: np.ndarray
    n1: np.ndarray
    log_w: np.ndarray
    share: np.ndarray


def tree(runs: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[list[list[Nodes]], list[np.ndarray], list[np.ndarray]]:
    """From distinct ascending runs: nodes from depth ``top`` to ``depth``, the contexts with a byte of each depth,

    and for each depth but the last, where the next depth's contexts with a byte are found in it.
    Runs without visits change nothing: their probability of nothing is one.
    """
    keys, visits, ups = [runs], [counts.astype(float)], []
    for d in range(depth - 1, top - 1, -1):
        key, up = np.unique(keys[0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        ups.insert(0, up)
        visits.insert(0, np.bincount(up, visits[0], len(key)))
        keys.insert(0, key)
    levels: list[list[Nodes]] = [[] for _ in keys]
    for i in range(len(keys) - 1, -1, -1):
        for bit in range(8):
            at = keys[i] >> np.uint64(8 - bit)
            new = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
            of, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = visits[i] * ((keys[i] >> np.uint64(7 - bit)) & np.uint64(1))
            n1, n = np.bincount(of, one, len(first)), np.bincount(of, visits[i], len(first))
            own = log_kt(n - n1, n1)
            if i == len(keys) - 1:
                log_w, share = own, np.ones(len(own))
            else:
                child = levels[i + 1][bit]
                log_w, share = mixed(own, np.bincount(of[ups[i][child.first]], child.log_w, len(first)))
            levels[i].append(Nodes(of, first, n - n1, n1, log_w, share))
    return levels, keys, ups


def mixed(own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of P_w of nodes with children, and the share of their own estimate in it."""
    return np.logaddexp(own, deeper) - LOG2, 1 / (1 + np.exp(np.clip(deeper - own, -700, 700)))


@dataclass
class Model:
    """Nodes above the parts, ascending, by depth << 56 | context << 8 | bits; the probability of a one, and the own share.

    Their number is bounded by the alphabet: contexts of fewer than ``top`` bytes.
    """

    depth: int
    top: int
    nodes: np.ndarray
    one: np.ndarray
    share: np.ndarray

    def log2_of(self, runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Base-2 log probability of the last byte of each distinct run of a part, ascending, with its training count."""
        levels, _, ups = tree(runs, counts, self.depth, self.top)
        total = np.zeros(len(runs))
        for bit in range(8):
            last = levels[-1][bit]
            at, p, below = last.first, np.full(len(last.first), 0.5), np.zeros(len(last.first), bool)
            for i in range(len(levels) - 1, -1, -1):
                nodes = levels[i][bit]
                if i < len(levels) - 1:
                    at = ups[i][at]
                node = nodes.of[at]
                n = (nodes.n0 + nodes.n1)[node]
                p, below = _step(p, below, n >= LEAST, ((nodes.n1 + 0.5) / (nodes.n0 + nodes.n1 + 1))[node], nodes.share[node])
            first = runs[last.first]
            low = np.uint64(1 << bit) | ((first & np.uint64(255)) >> np.uint64(8 - bit))
            for d in range(self.top - 1, -1, -1):
                context = ((first >> np.uint64(8)) & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)
                name = np.uint64(d << 56) | context | low
                at = np.minimum(np.searchsorted(self.nodes, name), max(len(self.nodes) - 1, 0))
                found = self.nodes[at] == name if len(self.nodes) else np.zeros(len(name), bool)
                if len(self.nodes):
                    p, below = _step(p, below, found, self.one[at], self.share[at])
            value = ((runs >> np.uint64(7 - bit)) & np.uint64(1)) == 1
            p = p[last.of]
            total += np.log2(np.where(value, p, 1 - p))
        return total


def _step(p, below, used, one, share):
    """One depth up: the deepest used node is a leaf; above it, estimates are mixed."""
    share = np.where(below, share, 1.0)
    return np.where(used, share * one + (1 - share) * p, p), used


# Gathering ------------------------------------------------------------------


def _parts_of_runs(code: np.ndarray, top: int, parts: int) -> np.ndarray:
    """By the context bytes next to the byte: all their deeper contexts meet in one part."""
    key = ((code >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _parts_of_words(name: np.ndarray, parts: int, words: int) -> np.ndarray:
    """Numbered behind the parts of the tree."""
    return parts + (name % np.uint64(words)).astype(np.int64)


def _split(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each part with what the columns have of it, in their order."""
    order = np.argsort(part, kind="stable")
    names, starts = np.unique(part[order], return_index=True)
    yield from zip(names.tolist(), *(np.split(c[order], starts[1:]) for c in columns), strict=True)


def _named(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def _scan(depth: int, parts: int, words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rows in rows_of(batches, SLICE):
            yield _slice(rows, depth, parts, words, number)
            number += 1

    return scan


def _chunks(streams: list[bytes]) -> Iterator[slice]:
    """Neighbouring streams of at most ``CHUNK`` bytes together, or one."""
    start, size = 0, 0
    for i, stream in enumerate(streams):
        if i > start and size + len(stream) > CHUNK:
            yield slice(start, i)
            start, size = i, 0
        size += len(stream)
    if streams:
        yield slice(start, len(streams))


def _runs_of(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs, ascending, with their counts; in memory only a chunk's runs and distinct ones."""
    waiting, held = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0
    for part in _chunks(streams):
        waiting.append(np.unique(byte_runs(streams[part], depth), return_counts=True))
        if sum(len(w[0]) for w in waiting) > 2 * held + 500_000:
            waiting = [_merged(waiting)]
            held = len(waiting[0][0])
    return _merged(waiting)


def _merged(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))


def _slice(rows: pa.RecordBatch, depth: int, parts: int, words: int, number: int) -> pa.RecordBatch:
    taught = rows.column("taught").to_numpy(zero_copy_only=False)
    streams, counts = [], {}
    for text, learn in zip(rows.column("text").to_pylist(), taught.tolist(), strict=True):
        found, stream = normal_bytes(text)
        found.append(END)  # the end, counted as a token
        for w in found:
            counts[w] = counts.get(w, 0) + learn
        streams.append(stream)
    out: list[tuple] = []
    learned = [s for s, t in zip(streams, taught, strict=True) if t]
    others = [s for s, t in zip(streams, taught, strict=True) if not t]
    code, n = _runs_of(learned, depth)
    asked, none = _runs_of(others, depth)
    code, n = _merged([(code, n), (asked, 0 * none)])
    for p, c, m in _split(_parts_of_runs(code, min(TOP, depth), parts), code, n):
        out.append((0, p, number, packed(c), squeezed(m.astype(np.uint32)), None, None, None))
    name, n = _counted(_named(list(counts)), np.fromiter(counts.values(), np.int64, len(counts)))
    for p, c, m in _split(_parts_of_words(name, parts, words), name, n):
        out.append((1, p, number, packed(c), squeezed(m.astype(np.uint32)), None, None, None))
    doc_ids = rows.column("doc_id")
    known = np.array([x is not None for x in doc_ids.to_pylist()])
    out.append((2, 0, number, doc_ids.fill_null(0).to_numpy().tobytes(), known.tobytes(),
                np.array([len(x) for x in streams], np.int64).tobytes(), taught.tobytes(),
                squeezed(np.frombuffer(b"".join(streams), np.uint8))))
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "part", "slice", "a", "b", "c", "d", "e"])


def _part(kind: int, part: int, number: int, a: bytes, b: bytes) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, part, number, a, b), types, strict=True)], names=["kind", "part", "slice", "a", "b"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one, so that only one row's values are objects at a time."""
    for rows in batches:
        for i in range(rows.num_rows):
            yield tuple(c[i].as_py() for c in rows.columns)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by part: each part's distinct codes with their counts, one row a part.

    Words are dealt evenly, so that a part can hold what its slices ask for: the counts of
    each slice's words follow.
    """
    kind, current, waiting, held, asking = 0, None, [], 0, []

    def part_of() -> Iterator[pa.RecordBatch]:
        code, n = _merged(waiting)
        yield _part(kind, current, -1, packed(code) if kind == 0 else None, squeezed(n))
        for number, a in asking:
            yield _part(kind, current, number, None, squeezed(n[np.searchsorted(code, unpacked(a))]))

    for k, part, number, a, b in _each(batches):
        if part != current and waiting:
            yield from part_of()
            waiting, held, asking = [], 0, []
        kind, current = k, part
        waiting.append((unpacked(a), values_of(b, np.uint32).astype(np.int64)))
        if kind == 1:
            asking.append((number, a))
        # Rows are added up before they are twice what is distinct among them.
        if sum(len(w[0]) for w in waiting) > 2 * held + 500_000:
            waiting = [_merged(waiting)]
            held = len(waiting[0][0])
    if waiting:
        yield from part_of()


NODES = "depth int, node bigint, n0 double, n1 double, log_w double, share double"


def _node_rows(depth: int, node, n0, n1, log_w, share) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(node), depth, np.int32)), pa.array(np.asarray(node).astype(np.int64)), *(pa.array(np.asarray(x, float)) for x in (n0, n1, log_w, share))],
        names=[f.split()[0] for f in NODES.split(", ")],
    )


def _tops(depth: int, top: int):
    """The nodes of a part's topmost depth."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, a, b in _each(batches):
            n = values_of(b, np.int64)
            levels, keys, _ = tree(unpacked(a)[n > 0], n[n > 0], depth, top)
            for bit, nodes in enumerate(levels[0]):
                first = keys[0][nodes.first]
                name = (first >> np.uint64(8) << np.uint64(8)) | np.uint64(1 << bit) | ((first & np.uint64(255)) >> np.uint64(8 - bit))
                yield _node_rows(top, name, nodes.n0, nodes.n1, nodes.log_w, nodes.share)

    return tops


def _above(depth: int):
    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            node, n0, n1, deeper = (rows.column(c).to_numpy() for c in ("node", "n0", "n1", "deeper"))
            yield _node_rows(depth, node, n0, n1, *mixed(log_kt(n0, n1), deeper))

    return above


def _gathered(docs: DataFrame, depth: int, parts: int, words: int) -> DataFrame:
    rows = texts(docs).withColumn("taught", remainder(F.col("doc_id"), 10) != 0)
    return written(rows.mapInArrow(_scan(depth, parts, words), KINDS))


def fit(combined: DataFrame, depth: int) -> Model:
    """The nodes above the parts, from the topmost nodes of each."""
    top = min(TOP, depth)
    found = []
    if top:
        below = written(combined.filter("kind = 0").mapInArrow(_tops(depth, top), NODES))
        for d in range(top - 1, -1, -1):
            name = F.col("node").bitwiseAND(F.lit((1 << 8 * (d + 1)) - 1)).alias("node")
            sums = below.groupBy(name).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log_w").alias("deeper"))
            below = written(sums.mapInArrow(_above(d), NODES))
            kept = below.filter(F.col("n0") + F.col("n1") >= LEAST).mapInArrow(_records, "nodes binary")
            found += [np.frombuffer(r["nodes"], RECORD) for r in kept.collect()]
    records = np.concatenate([*found, np.empty(0, RECORD)])
    records.sort(order="node")
    return Model(depth, top, *(np.ascontiguousarray(records[name]) for name in RECORD.names))


RECORD = np.dtype([("node", "<u8"), ("one", "<f8"), ("share", "<f8")])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes packed, 24 bytes each: what the driver gathers and the tasks get."""
    for rows in batches:
        depth, node, n0, n1, share = (rows.column(c).to_numpy() for c in ("depth", "node", "n0", "n1", "share"))
        out = np.empty(len(node), RECORD)
        out["node"] = (depth.astype(np.uint64) << np.uint64(56)) | node.view(np.uint64)
        out["one"], out["share"] = (n1 + 0.5) / (n0 + n1 + 1), share
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["nodes"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct training words, and all of them."""
    distinct, total = 0, 0
    for *_, b in _each(batches):
        n = values_of(b, np.int64)
        distinct, total = distinct + int((n > 0).sum()), total + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([distinct], pa.int64()), pa.array([total], pa.int64())], names=["distinct", "total"])


def _values(model: Model):
    """Per part of the tree: its runs, and their log probabilities."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, part, _, a, b in _each(batches):
            yield _part(kind, part, -1, a, squeezed(model.log2_of(unpacked(a), values_of(b, np.int64)).astype(np.float32)))

    return values


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part and slice, the part's own row first: the values of each slice's runs, one slice at a time."""
    codes, values = np.empty(0, np.uint64), np.empty(0)
    for kind, part, number, a, b in _each(batches):
        if number < 0:
            codes, values = unpacked(a), values_of(b, np.float32)
        else:
            yield _part(kind, part, number, None, squeezed(values[np.searchsorted(codes, unpacked(a))]))


def _finish(depth: int, parts: int, words: int, distinct: int, total: int):
    """Sorted by slice, the answers before the slice's texts."""
    shift = float(np.log10(total + 0.1 * (distinct + 1)))

    def judge(answers, a, b, c, e) -> pa.RecordBatch:
        ids, there, sizes = np.frombuffer(a, np.int64), np.frombuffer(b, bool), np.frombuffer(c, np.int64)
        ends, e = np.cumsum(sizes), values_of(e, np.uint8).tobytes()
        streams = [e[end - size : end] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]

        def answered(code, part, kind):
            value = np.empty(len(code), kind)
            for p, at in _split(part, np.arange(len(code))):
                value[at] = values_of(answers[p], kind)
            return value

        found = []
        for part in _chunks(streams):
            own, inverse = np.unique(byte_runs(streams[part], depth), return_inverse=True)
            found.append((part, own, inverse.astype(np.uint32)))
        code = np.unique(np.concatenate([own for _, own, _ in found]))
        value = answered(code, _parts_of_runs(code, min(TOP, depth), parts), np.float32)
        bits = np.zeros(len(ids))
        for part, own, inverse in found:
            some = sizes[part]
            bits[part] = np.bincount(np.repeat(np.arange(len(some)), some), value[np.searchsorted(code, own)][inverse], len(some))
        del code, value, found
        index: dict[bytes, int] = {}
        tokens, at = np.zeros(len(ids), np.int64), []
        for i, stream in enumerate(streams):
            found = [*stream.split(), END]
            tokens[i] = len(found)
            at.append(np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64, len(found)))
        name, place = np.unique(_named(list(index)), return_inverse=True)
        count = answered(name, _parts_of_words(name, parts, words), np.int64)[place][np.concatenate(at)]
        doc = np.repeat(np.arange(len(ids)), tokens)
        base = np.bincount(doc, np.log10(count + 0.1), len(ids)) - tokens * shift
        known = np.bincount(doc, count > 0, len(ids)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=~there), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), total)), pa.array(base),
             pa.array(bits * np.log10(2.0)), pa.array(-bits / sizes)],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, bytes] = {}
        for kind, part, _, a, b, c, _, e in _each(batches):
            if kind < 2:
                answers[part] = b
            else:
                yield judge(answers, a, b, c, e)
                answers = {}

    return finish


def _numbers_of_parts(docs: DataFrame) -> tuple[int, int]:
    """Of the tree, and of the words: both follow the bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return spread_parts(docs.sparkSession, size, PART), spread_parts(docs.sparkSession, size, WORD_PART, 32)


def score_texts(docs: DataFrame, depth: int = 5) -> DataFrame:
    """Per row: doc_id, held_out, the word model's figures, score, and bits_per_byte.

    Rows whose crc32 modulo 10 is 0 are held out from both models.
    """
    parts, words = _numbers_of_parts(docs)
    gathered = _gathered(docs, depth, parts, words)
    coded = gathered.filter("kind < 2").select("kind", "part", "slice", "a", "b")
    tasks = spread_parts(docs.sparkSession, parts + words, 4)
    combined = written(coded.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(_combined, PARTS))
    model = fit(combined, depth)
    size = combined.filter("kind = 1 AND slice < 0").mapInArrow(_words, "distinct bigint, total bigint").agg(F.sum("distinct"), F.sum("total")).first()
    asked = coded.filter("kind = 0").withColumn("b", F.lit(None).cast("binary"))
    met = combined.filter("kind = 0").mapInArrow(_values(model), PARTS).unionByName(asked)
    answers = written(met.repartition(tasks, "part").sortWithinPartitions("part", "slice").mapInArrow(_answers, PARTS))
    answers = answers.unionByName(combined.filter("kind = 1 AND slice >= 0"))
    rows = gathered.filter("kind = 2")
    none = F.lit(None).cast("binary")
    both = rows.unionByName(answers.withColumns({"c": none, "d": none, "e": none}))
    slices = spread_parts(docs.sparkSession, rows.select("slice").count(), 16)
    scored = both.repartition(slices, "slice").sortWithinPartitions("slice", "kind").mapInArrow(
        _finish(depth, parts, words, size[0] or 0, size[1] or 0),
        "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double",
    )
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte",
    )
