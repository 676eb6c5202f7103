"""Near copies by a parity-sketch join on word shingles.

Every shingle of a set flips one bit of the set's sketch. Two sketches differ in at
most as many bits as the sets in elements, and a Jaccard similarity bounds that
difference by ``D`` for given sizes. Sizes fall into bands; a band's sketch is cut
into more than ``D`` words, so two linked sets agree in at least one word (pigeonhole).
For this the words are 2^32 bits wide, few of which are set, and held as the XOR of the
hashes of the set bits; they are the join keys. Of the classes they bring together,
narrow sketches of two to four bits per shingle drop those whose Hamming distance is
above ``D``; the rest is verified on the whole sets.

Equal sets are one class from the start. Keys held by one class are dropped where
keys are gathered. For the rest:

1. every class is verified against the smallest class of each of its keys, and the
   links found are joined into components;
2. classes that share a key and are still in different components are compared by
   their narrow sketches, and verified if close: first, in ``rounds`` that each join the
   components anew, of each key no more than each component's closest pair, then all
   that are still apart. Keys with the same classes count once. Crowded keys that hold
   the same classes again and again make a family, whose classes are compared once, all
   with all. Where that would cost more than the keys by themselves, as with unrelated
   texts that have a line in common, they stay keys; of those with more than ``group``
   classes, these first have to agree in a word of another sketch as well, and so on,
   at most ``levels`` times.

No link between components is lost, and no key emits pairs of classes already
together, so a large group of near copies costs one verification per member and key.

A word without a set bit says little. Bands have spare words, so that sets with few
empty words meet in a full one; the rare sets with more than that also use their empty
words as keys, among themselves.

Shingles and classes are 64-bit hashes, keys have 48 bits. Defined cases: null texts and texts without
words have no set and are their own component; fewer words than a shingle are one
shingle; rows with equal ids are rows of their own; a null id is never the smallest
unless alone; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import first_of, numbered, rows_of, shuffles_removed, spread_parts, texts
from atticsweep.llm.components import FEW_BYTES, components, joined
from atticsweep.operators.lookup import settled
from atticsweep.session import written

MIX = np.uint64(0xBF58476D1CE4E5B9)


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    if len(words) < k:
        return np.array([digest(b" ".join(words))], np.uint64)
    grams = zip(*(words[i:] for i in range(k)), strict=False)
    return np.unique(np.fromiter((digest(b" ".join(g)) for g in grams), np.uint64, len(words) - k + 1))


def class_of(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


class Bands:
    """Size bands, and for each the number of sketch words that a linked pair needs."""

    def __init__(self, percent: int, ratio: float = 1.4):
        self.percent = percent
        # Below this size two different sets cannot link.
        first = next(n for n in range(1, 10_000) if 100 * n >= percent * (n + 1))
        self.starts, at = [first], first
        while at < 1 << 40:
            at = max(at + 1, int(at * ratio))
            self.starts.append(at)

    @lru_cache(maxsize=4096)  # noqa: B019
    def words(self, band: int) -> tuple[int, int, int]:
        """The largest size in a band's pairs, its words, and how many may be empty."""
        low, high = self.starts[band], self.starts[band + 1] - 1
        top = high * 100 // self.percent
        differ = (100 - self.percent) * (high + top) // (100 + self.percent)
        spare, total = 0, differ + 1
        while True:
            mean = total * math.exp(-low / total)
            bound = math.ceil(mean + 4 * math.sqrt(mean)) if mean > 0.005 else 0
            # Small sets would need ever more: there a third is enough, and more of them count as rare.
            if bound <= spare or spare >= (differ + 1) // 3 + 1:
                return top, total, spare
            spare, total = spare + 1, total + 1

    def of(self, size: int) -> list[int]:
        """The bands a set of this size takes part in."""
        if size < self.starts[0]:
            return []
        band = int(np.searchsorted(self.starts, size, side="right")) - 1
        found = []
        while band >= 0 and size <= self.words(band)[0]:
            found.append(band)
            band -= 1
        return found


def _mixed(shingles: np.ndarray, seed: int) -> np.ndarray:
    h = (shingles ^ np.uint64(seed * 0x9E3779B9 + 1)) * MIX
    h ^= h >> np.uint64(31)
    return h * MIX


def sketch(shingles: np.ndarray) -> bytes:
    """Parity bits of the shingles: a power of two of bits, at least two per shingle."""
    bits = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    place = (_mixed(shingles, 97) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches; the longer one is folded, which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def words_of(shingles: np.ndarray, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch's words with a set bit, and each one's XOR of the hashes of its set bits."""
    h = _mixed(shingles, seed)
    word = ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    order = np.argsort(word, kind="stable")
    place, first = np.unique(word[order], return_index=True)
    return place, np.bitwise_xor.reduceat((h * np.uint64(0xD6E8FEB86659FD93))[order], first)


def join_keys(shingles: np.ndarray, bands: Bands, seed: int) -> np.ndarray:
    """The keys of a set, of ``KEY_BITS`` bits: its sketch words in all its bands."""
    keys = []
    for band in bands.of(len(shingles)):
        _, words, spare = bands.words(band)
        place, row = words_of(shingles, words, seed)
        if words - len(place) > spare:  # a rare set: its empty words are keys as well
            empty = np.setdiff1d(np.arange(words, dtype=np.uint64), place)
            place, row = np.concatenate([place, empty]), np.concatenate([row, np.zeros(len(empty), np.uint64)])
        h = (row + np.uint64(seed + 1)) * MIX
        h = (h ^ (h >> np.uint64(29)) ^ (place << np.uint64(20)) ^ np.uint64(band)) * np.uint64(0x94D049BB133111EB)
        keys.append((h ^ (h >> np.uint64(32))) >> np.uint64(64 - KEY_BITS))
    return np.unique(np.concatenate(keys)).view(np.int64) if keys else np.empty(0, np.int64)


FEW_KEYS = 32
REFINED = 40  # a class's row of a large key costs as much as so many comparisons for each shingle, as its refined keys do
FEW_CLASSES = 64  # of so few, all pairs are compared at once
MOST_BLOCKS, BLOCK_BYTES = 32, 8 << 20  # of a family, while its sketches allow
PAIRS_A_ROW = 8  # keys with no more pairs than that for each of their rows are compared in one go
KEY_BITS = 48  # equal keys of unequal words cost a comparison, no more
SCANNED = "doc_id bigint, n_shingles bigint, class bigint, sketch binary, bucket bigint, key bigint, packed binary"
MET = SCANNED.replace("bucket bigint, ", "").replace(", packed binary", "")


def packed(pairs: np.ndarray) -> bytes:
    """Pairs of a key and a class, ascending by key: the steps from key to key and the classes, byte by byte, by zstd.

    In front stands the number of pairs.
    """
    columns = [np.diff(pairs[:, 0], prepend=np.int64(0)), np.ascontiguousarray(pairs[:, 1])]
    data = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)
    return len(pairs).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    plain = np.frombuffer(pa.decompress(memoryview(data)[8:], 16 * n, codec="zstd", asbytes=True), np.uint8)
    steps, owner = (np.ascontiguousarray(part.reshape(8, -1).T).view(np.int64).ravel() for part in np.split(plain, 2))
    return np.stack([np.cumsum(steps), owner], axis=1)


def _scanned(k: int, percent: int, buckets: int, crowd: int):
    """A row for each document, and the keys of its slice with their classes, packed by bucket, which is a range of keys.

    Keys that ``crowd`` classes of a slice share go out as rows of their own; one
    class of them stays in the packed form, so that other slices meet it. The shingles
    of a text are made once for all of this. Rows that are not packed are dealt to the
    buckets in turn, wherever their keys are.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, turn = Bands(percent), 0

        def in_turn(n: int) -> np.ndarray:
            nonlocal turn
            turn = (turn + n) % buckets
            return (turn + np.arange(n)) % buckets

        for rows in rows_of(batches, 16 << 20):
            done, keys, owners, sizes, classes, sketches = set(), [], [], [], [], []
            for text in rows.column("text").to_pylist():
                shingles = shingle_set(text, k)
                sizes.append(len(shingles))
                own = class_of(shingles) if len(shingles) else None
                classes.append(own)
                sketches.append(sketch(shingles) if len(shingles) else None)
                if own is None or own in done:
                    continue
                done.add(own)
                found = join_keys(shingles, bands, 0)
                keys.append(found)
                owners.append(np.full(len(found), own))
            turn += (classes[0] or 0) % buckets  # small partitions do not all begin at one bucket
            yield _rows(len(sizes), doc_id=rows.column("doc_id"), n_shingles=sizes, **{"class": classes}, sketch=sketches, bucket=in_turn(len(sizes)))
            key, owner = _sorted(keys, owners)
            _, first, often = np.unique(key, return_index=True, return_counts=True)
            crowded = np.repeat(often >= crowd, often)
            keep = ~crowded
            keep[first] = True
            many = int(crowded.sum())
            yield _rows(many, key=key[crowded], **{"class": owner[crowded]}, bucket=in_turn(many))
            key, owner = key[keep], owner[keep]
            names, starts = np.unique(key // -(-(1 << KEY_BITS) // buckets), return_index=True)
            parts = np.split(np.stack([key, owner], axis=1), starts[1:]) if len(names) else []
            yield _rows(len(names), bucket=names, packed=[packed(p) for p in parts])

    return scan


def _sorted(keys: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((owner, key))
    return key[order], owner[order]


def _rows(n: int, schema: str = SCANNED, **columns) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(name, [None] * n), pa.int64() if kind == "bigint" else pa.binary()) for name, kind in fields],
        names=[name for name, _ in fields],
    )


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's packed keys, those held by two classes or more; one bucket in memory at a time. Other rows pass."""

    def shared(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))[: len(pairs)]]
        same = np.append(False, pairs[1:, 0] == pairs[:-1, 0])[: len(pairs)]
        pairs = pairs[same | np.append(same[1:], False)[: len(pairs)]]
        return _rows(len(pairs), MET, key=pairs[:, 0], **{"class": pairs[:, 1]})

    current, parts = None, []
    for rows in batches:
        held = rows.column("packed").is_valid()
        yield rows.filter(pc.invert(held)).select([f.split()[0] for f in MET.split(", ")])
        rows = rows.filter(held)
        for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist(), strict=True):
            if bucket != current and parts:
                yield shared(parts)
                parts = []
            current = bucket
            parts.append(unpacked(data))
    yield shared(parts)


def _verified(k: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            known: dict[int, np.ndarray] = {}

            def own(name, text, known=known):
                if name not in known:
                    known[name] = shingle_set(text, k)
                return known[name]

            a, b = [], []
            for x, y, left, right in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                p, q = own(x, left), own(y, right)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    a.append(x), b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return verify


def _close(percent: int):
    """Pairs whose sketches are no farther apart than a link allows."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep = [
                distance(s, t) <= (100 - percent) * (m + n) // (100 + percent)
                for s, t, m, n in zip(*(rows.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")), strict=True)
            ]
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return close


def _folded(sketches: bytes, many: int, to: int) -> np.ndarray:
    """Sketches of one length as rows of words, folded to ``to`` bytes, which keeps parities."""
    words = np.frombuffer(sketches, np.uint64).reshape(many, -1)
    while words.shape[1] > to // 8:
        words = words[:, : words.shape[1] // 2] ^ words[:, words.shape[1] // 2 :]
    return words


def _near_in_keys(percent: int, closest: bool):
    """Reads a partition sorted by key and two blocks of its classes; holds the sketches of these at a time.

    Of two different blocks only pairs across them come out. With ``closest`` it is each component's pair with the
    closest sketches alone: no more pairs than components. One that has more than half of the classes waits for the others' pairs.
    """

    def near(
        key: int, across: bool, name: np.ndarray, comp: np.ndarray, n: np.ndarray, block: np.ndarray, sketches: list[bytes], keys: list[frozenset]
    ) -> tuple[np.ndarray, np.ndarray]:
        found = []

        def compared(part: np.ndarray, some: np.ndarray, x: np.ndarray, y: np.ndarray, once: bool) -> None:
            """Those of ``part`` and ``some``, whose sketches' words are the columns of ``x`` and ``y``; ``once``: both are the same, and a pair counts once."""
            if len(part) * len(some) <= 1 << 12:
                differ = np.bitwise_count(x[:, :, None] ^ y[:, None, :]).sum(axis=0, dtype=np.int64)
            else:
                differ = np.zeros((len(part), len(some)), np.int32)
                for p, q in zip(x, y, strict=True):
                    differ += np.bitwise_count(p[:, None] ^ q[None, :])
            small, large = np.minimum(n[part, None], n[None, some]), np.maximum(n[part, None], n[None, some])
            ok = (differ * np.int64(100 + percent) <= (100 - percent) * (small + large)) & (100 * small >= percent * large)
            ok &= comp[part, None] != comp[None, some]
            if across:
                ok &= block[part, None] != block[None, some]
            if closest:
                far = np.where(ok, differ / (small + large), np.inf)
                j = far.argmin(axis=1)
                i = np.flatnonzero(ok.any(axis=1))
                found.append((part[i], some[j[i]], far[i, j[i]]))
                return
            if once:
                ok &= name[part, None] < name[None, some]
            i, j = np.nonzero(ok)
            i, j = part[i], some[j]
            first = [keys[x] is None or keys[y] is None or min(keys[x] & keys[y]) == key for x, y in zip(i.tolist(), j.tolist(), strict=True)]
            found.append((i[first], j[first], np.zeros(sum(first))))

        if len(name) <= FEW_CLASSES:
            least = min(map(len, sketches))
            every, x = np.arange(len(name)), np.concatenate([_folded(s, 1, least) for s in sketches]).T
            compared(every, every, x, x, not closest)
        else:
            order = np.argsort(n, kind="stable")  # and so by length of the sketch
            sketches, keys = [sketches[i] for i in order], [keys[i] for i in order]
            name, comp, n, block = name[order], comp[order], n[order], block[order]
            width = np.array([len(x) for x in sketches])
            start = dict(zip(*(x.tolist() for x in np.unique(width, return_index=True)), strict=True))
            folds: dict[tuple[int, int], np.ndarray] = {}

            def words(of: int, to: int, rows: np.ndarray) -> np.ndarray:
                if (of, to) not in folds:
                    held = [x for x in sketches if len(x) == of]
                    folds[of, to] = np.ascontiguousarray(_folded(b"".join(held), len(held), to).T)
                return folds[of, to][:, rows - start[of]]

            def meet(left: np.ndarray, right: np.ndarray, once: bool = False) -> None:
                """Each of ``left`` with those of ``right`` whose size allows it."""
                step = max(1, (1 << 17) // max(1, len(right)))
                for wide in np.unique(width[left]).tolist():
                    rows = left[width[left] == wide]
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        low = np.searchsorted(n[right], -(-percent * n[part[0]] // 100))
                        some = right[low : np.searchsorted(n[right], 100 * n[part[-1]] // percent, side="right")]
                        for other in np.unique(width[some]).tolist():
                            own, least = some[width[some] == other], min(wide, other)
                            compared(part, own, words(wide, least, part), words(other, least, own), once)

            names, often = np.unique(comp, return_counts=True)
            most = comp == names[often.argmax()]
            if closest and 2 * most.sum() <= len(most):
                most[:] = False
            held, rest = np.flatnonzero(most), np.flatnonzero(~most)
            if across:
                mine = block == block.min()
                meet(rest[mine[rest]], np.flatnonzero(~mine))
                if closest:
                    meet(rest[~mine[rest]], np.flatnonzero(mine))
                else:
                    meet(held[mine[held]], rest[~mine[rest]])
            elif closest:
                meet(rest, np.arange(len(n)))
            else:
                meet(rest, rest, once=True)
                meet(rest, held)
        i, j, far = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]) for c in range(3))
        if closest:
            order = np.lexsort((far, comp[i]))
            _, first = np.unique(comp[i][order], return_index=True)
            i, j = i[order][first], j[order][first]
        return np.minimum(name[i], name[j]), np.maximum(name[i], name[j])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: tuple, held: list[tuple]) -> pa.RecordBatch:
            key, low, high = group
            name, comp, n, block, sketches, keys = zip(*held, strict=True)
            a, b = near(key, low != high, *(np.array(x, np.int64) for x in (name, comp, n, block)), sketches, [k and frozenset(k) for k in keys])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        current, held = None, []
        for rows in batches:
            for key, low, high, *row in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if (key, low, high) != current and held:
                    yield pairs(current, held)
                    held = []
                current = (key, low, high)
                held.append(row)
        if held:
            yield pairs(current, held)

    return compare


class _Classes:
    """What is known of the classes that share a key: size, sketch, one document; and their texts where needed."""

    def __init__(self, docs: DataFrame, rows: DataFrame, members: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent = docs, k, percent
        known = rows.join(members.select("class").distinct().hint("merge"), "class", "left_semi")
        # All rows of a class have the same size and sketch.
        self.marks = written(known.groupBy("class").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """``class`` and ``text`` for the classes in column ``class``; written."""
        chosen = self.marks.select("class", "id").join(settled(wanted.distinct(), FEW_BYTES).hinted(), "class", "left_semi")
        # While few are wanted, no other text moves.
        own = texts(self.docs).join(settled(chosen, FEW_BYTES).hinted(), F.col("doc_id").eqNullSafe(F.col("id"))).select("class", "text")
        return written(own.mapInArrow(_of_class(self.k), "class bigint, text string").dropDuplicates(["class"]))

    def families(self, open_: DataFrame, group: int, refined: int) -> DataFrame:
        """key, class and blocks: the rows of ``open_``, with families in place of the crowded keys that make them up; written.

        A family is what crowded keys join, and its key one of its classes. Its classes are to meet in ``blocks`` blocks. Families
        for whose keys a comparison by themselves, or a refinement of large ones, costs less than all pairs stay keys.
        """
        crowded = written(open_.filter(F.col("size") > group // 8).select("key", "class", "size", "large"))
        if crowded.isEmpty():
            return open_.select("key", "class", "blocks")
        least = crowded.groupBy("key").agg(F.min("class").alias("a"))
        met = crowded.join(written(least).hint("merge"), "key").select("a", F.col("class").alias("b")).filter("a <> b").distinct()
        family = components(met).select(F.col("node").alias("class"), F.col("comp").alias("family"))
        sizes = self.marks.select("class", "n", F.octet_length("sketch").alias("width"))
        own = written(crowded.join(written(family).hint("merge"), "class").join(sizes.hint("merge"), "class"))
        alone = F.sum(F.when(F.col("large"), F.col("n") * refined).otherwise(F.col("size")))
        each = own.groupBy("family", "class").agg(alone.alias("alone"), F.max("width").alias("width"))
        whole = each.groupBy("family").agg(F.count(F.lit(1)).alias("many"), F.sum("alone").alias("alone"), F.sum("width").alias("width"))
        blocks = F.greatest(F.least(F.ceil(F.col("many") / group), F.lit(MOST_BLOCKS)), F.ceil(F.col("width") / BLOCK_BYTES))
        close = settled(whole.filter("many * many <= alone").select("family", blocks.cast("bigint").alias("blocks")), FEW_BYTES)
        if close.empty:
            return open_.select("key", "class", "blocks")
        inside = written(own.join(close.hinted(), "family").select("family", "key", "class", "blocks"))
        rest = open_.join(settled(inside.select("key").distinct(), FEW_BYTES).hinted(), "key", "left_anti").select("key", "class", "blocks")
        return written(rest.unionByName(inside.select(F.col("family").alias("key"), "class", "blocks").distinct()))

    def within_keys(self, rows: DataFrame, closest: bool = False) -> DataFrame:
        """Pairs of classes of one key, in different components, whose sketches are close enough.

        ``blocks`` says into how many blocks a key's classes are dealt; each two
        blocks meet in a group of their own. Null is one block. ``closest``: of each key, each component's
        closest pair alone.
        """
        # Of the keys that a pair shares, the smallest one gives it. A long text has many keys, and each of its rows
        # would carry them all: it goes without, and gives a pair once for each key they share.
        keys = rows.groupBy("class").agg(F.collect_list("key").alias("keys"))
        keys = keys.withColumn("keys", F.when((F.size("keys") <= FEW_KEYS) & F.lit(not closest), F.col("keys")))
        known = written(self.marks.select("class", "n", "sketch").join(keys.hint("merge"), "class"))
        marked = rows.join(known.hint("merge"), "class")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = marked.withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        marked = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        groups = ["key", "low", "high"]
        columns = [*groups, "class", "comp", "n", "block", "sketch", "keys"]
        sorted_ = marked.select(*columns).repartition(parts, *groups).sortWithinPartitions(*groups)
        return sorted_.mapInArrow(_near_in_keys(self.percent, closest), "a bigint, b bigint")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs of classes, those that link; written."""
        a, b = (
            self.marks.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
            for c in ("a", "b")
        )
        near = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        close = written(pairs.join(a, "a").join(b, "b").filter(near).mapInArrow(_close(self.percent), "a bigint, b bigint"))
        if close.isEmpty():
            return close
        own = self.texts(close.select(F.col("a").alias("class")).unionByName(close.select(F.col("b").alias("class"))))
        left, right = (own.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")).hint("merge") for c in ("a", "b"))
        both = close.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
        return written(both.mapInArrow(_verified(self.k, self.percent), "a bigint, b bigint"))


def _refined(k: int, percent: int, seed: int):
    """For classes and the crowded keys they share: keys that also hold a word of another sketch."""

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for rows in rows_of(batches, 1 << 20):
            keys, owners = [], []
            for own, text, above in zip(*(rows.column(c).to_pylist() for c in ("class", "text", "keys")), strict=True):
                words = join_keys(shingle_set(text, k), bands, seed).view(np.uint64)
                for key in above:
                    h = (words ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * MIX
                    keys.append((h ^ (h >> np.uint64(31))).view(np.int64))
                    owners.append(np.full(len(words), own))
            key, owner = _sorted(keys, owners)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner)], names=["key", "class"])

    return refine


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes in different components."""
    known = settled(comps, FEW_BYTES)
    for c in ("a", "b"):
        own = known.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}")).hinted()
        pairs = pairs.join(own, c, "left").withColumn(f"comp_{c}", F.coalesce(f"comp_{c}", c))
    return pairs.filter("comp_a <> comp_b").select("a", "b")


def _mixed_keys(members: DataFrame, comps: DataFrame, level: int, group: int) -> DataFrame:
    """key, class, blocks and comp of the keys whose classes are not yet all in one component, their ``size``, and whether they are ``large``; written.

    A family, which has ``blocks``, is never large.
    """
    placed = members.join(settled(comps, FEW_BYTES).select(F.col("node").alias("class"), "comp").hinted(), "class", "left")
    placed = written(placed.withColumn("comp", F.coalesce("comp", "class")))
    sizes = placed.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size"),
        F.bit_xor(F.xxhash64("class")).alias("members"),
    )
    # At level 1 two classes have met in their star, or are together; refined keys have none. Keys with the same classes say the same.
    mixed = sizes.filter(f"low <> high AND size > {2 if level == 1 else 1}").groupBy("members", "size").agg(F.min("key").alias("key"))
    open_ = placed.join(settled(mixed.select("key", "size"), FEW_BYTES).hinted(), "key")
    return written(open_.withColumn("large", F.col("blocks").isNull() & (F.col("size") > group)))


def _load(open_: DataFrame) -> tuple[int, int, int]:
    """Of keys not ``large``, their rows and the pairs within them; the rows of large keys."""
    large = F.col("large")
    row = open_.agg(F.count_if(~large), F.sum(F.when(~large, F.col("size") - 1)), F.count_if(large)).first()
    return row[0], (row[1] or 0) // 2, row[2]


def near_copies(
    docs: DataFrame, k: int = 4, percent: int = 85, group: int = 2000, levels: int = 4, rounds: int = 3, refined: int = REFINED
) -> tuple[DataFrame, DataFrame]:
    """All rows with n_shingles and class (null without words), and each linked class's component."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = spread_parts(spark, size, 16 << 20)
    buckets = 4 * parts
    # Packed keys are larger than the texts at hand: they go to their buckets at once, and only what they share is written.
    scanned = texts(docs).mapInArrow(_scanned(k, percent, buckets, 16), SCANNED)
    met = written(scanned.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_keys, MET))
    rows = met.filter("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "class", "sketch")
    members = written(met.filter("key IS NOT NULL").select("key", "class").distinct())

    classes = _Classes(docs, rows, members, k, percent)
    least = members.groupBy("key").agg(F.min("class").alias("a"))
    stars = members.join(written(least).hint("merge"), "key").select("a", F.col("class").alias("b")).filter("a <> b").distinct()
    stars = written(stars)
    # First one star for each class; of the others, only those between classes that are still apart.
    tried = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    comps = written(components(classes.links(tried)))
    open_stars = written(_apart(stars.join(tried.hint("merge"), ["a", "b"], "left_anti"), comps))
    if not open_stars.isEmpty():
        tried = tried.unionByName(open_stars)
        comps = joined(comps, classes.links(open_stars))

    members = members.withColumn("blocks", F.lit(None).cast("bigint"))
    for level in range(1, levels + 1):
        open_ = _mixed_keys(members, comps, level, group)
        members = classes.families(open_, group, refined)
        open_ = _mixed_keys(members, comps, level, group)
        few, pairs, many = _load(open_)
        # While there are links among the closest pairs, those join most of what is one component.
        for _ in range(rounds):
            if pairs <= PAIRS_A_ROW * few:
                break
            near = classes.within_keys(open_.filter("NOT large").select("key", "class", "comp", "blocks"), closest=True).distinct()
            near = written(near.join(tried.hint("merge"), ["a", "b"], "left_anti"))
            more = classes.links(near)
            tried = tried.unionByName(near)
            if more.isEmpty():
                break
            comps = joined(comps, more)
            # Keys and families that are one component now stay so.
            open_ = _mixed_keys(open_.select("key", "class", "blocks"), comps, level, group)
            few, pairs, many = _load(open_)
        last = level == levels
        if few or (many and last):
            # What no sketch could split: blocks of a key against each other, only close pairs come out.
            blocks = F.when(F.col("large"), F.ceil(F.col("size") / group)).otherwise(F.col("blocks"))
            now = open_ if last else open_.filter("NOT large")
            apart = classes.within_keys(now.select("key", "class", "comp", blocks.cast("bigint").alias("blocks")))
            apart = written(apart.distinct().join(tried.hint("merge"), ["a", "b"], "left_anti"))
            if not apart.isEmpty():
                tried = tried.unionByName(apart)
                comps = joined(comps, classes.links(apart))
        large = open_.filter("large")
        if last or not many:
            break
        # A class's crowded keys: at most its number of words.
        keyed = large.groupBy("class").agg(F.collect_list("key").alias("keys"))
        members = classes.texts(keyed.select("class")).join(keyed.hint("merge"), "class").mapInArrow(_refined(k, percent, level), "key bigint, class bigint")
        members = written(members).withColumn("blocks", F.lit(None).cast("bigint"))
    return rows, comps


def _of_class(k: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that share an id with the one chosen may have other texts; those go."""
        for rows in rows_of(batches):
            own = [class_of(shingle_set(t, k)) == c for t, c in zip(rows.column("text").to_pylist(), rows.column("class").to_pylist(), strict=True)]
            yield rows.filter(pa.array(own, pa.bool_()))

    return check


def _placed(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """doc_id, n_shingles and comp of the rows that have words; written."""
    node = comps.select(F.col("node").alias("class"), "comp").hint("merge")
    placed = rows.filter("class IS NOT NULL").join(node, "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    return written(placed.select("doc_id", "n_shingles", "comp"))


def near_copy_components(docs: DataFrame, **settings: int) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links."""
    with shuffles_removed(docs.sparkSession):
        rows, comps = near_copies(docs, **settings)
        placed = _placed(rows, comps)
        smallest = written(placed.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    together = placed.join(smallest.hint("merge"), "comp").select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return together.unionByName(alone)


def one_of_each(docs: DataFrame, **settings: int) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that with the smallest id; of several, one.

    Rows are told apart by their number, so repeated and null ids do not matter.
    """
    with shuffles_removed(docs.sparkSession):
        own, row = numbered(docs)
        placed = _placed(*near_copies(own.select(F.col(row).alias("doc_id"), "text"), **settings))
        ids = texts(own, row).select("doc_id", F.xxhash64("text").alias("text_key"), row)
        known = written(ids.join(placed.select(F.col("doc_id").alias(row), "comp").hint("merge"), row))
        kept = written(known.groupBy("comp").agg(F.min(first_of(row)).alias("first")).select("comp", F.col("first.row").alias("kept_row")))
        gone = written(known.join(kept.hint("merge"), "comp").filter(F.col(row) != F.col("kept_row")).select(row))
    return own.join(gone.hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
