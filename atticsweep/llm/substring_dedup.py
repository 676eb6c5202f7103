"""Repeated passages by super-k-mer partitioning over words.

A window is ``k`` consecutive words. Its minimiser is the run of ``m`` words in it
with the smallest hash; consecutive windows with their minimiser at one place form a
super-k-mer, which travels as one packed string to the bucket of its minimiser. Equal
windows have equal minimisers, so a bucket sees all windows equal to one of its own,
and sorting them counts exactly.

1. One pass finds the super-k-mers. Only minimisers are counted; a minimiser chosen at
   one place only has no equal windows anywhere, and its super-k-mer stays at home.
2. Texts with other super-k-mers are kept apart. Equal packed strings are combined
   before they travel.
3. A minimiser chosen at more than ``hot`` places would fill one bucket. Its super-k-mers
   are split by a further minimiser of each window, under another seed; the two together
   are counted as in step 1, and what is chosen once stays at home. That goes on while
   something is hot and splitting still parts it: equal strings cannot be parted, and as
   they are combined they do not fill a bucket.
4. Windows found twice go back to their documents, whose covered words are removed.

Defined cases: null texts have no words; texts of fewer than ``k`` words keep all; rows that
repeat an id with the same text are two rows, so all their windows are repeated; very
long texts are one row of their words; an empty table gives an empty one; columns other
than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of, small_batches, spread_parts, texts
from atticsweep.session import written

KEY = ["doc_id", "text_key"]
MIX = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(words: list[bytes], k: int, m: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and number of windows of each super-k-mer; another seed orders the hashes anew."""
    n = len(words)
    if n < k:
        none = np.empty(0, np.int64)
        return none, none, none
    digest = xxhash.xxh3_64_intdigest
    word = np.fromiter((digest(w) for w in words), np.uint64, n)
    gram = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        gram = (gram ^ word[i : n - m + 1 + i]) * MIX
        gram ^= gram >> np.uint64(29)
    if seed:
        gram = (gram ^ np.uint64(seed)) * MIX
        gram ^= gram >> np.uint64(31)
    view = np.lib.stride_tricks.sliding_window_view(gram, k - m + 1)
    place = np.arange(len(view)) + view.argmin(axis=1)
    firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    runs = np.diff(np.append(firsts, len(place)))
    return gram[place[firsts]].view(np.int64), firsts, runs


def _keyed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("text_key", F.xxhash64("text"))


def _scan(k: int, m: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            n, sha, mins, firsts, runs = [], [], [], [], []
            for text in rows.column("text").to_pylist():
                words = text.encode("utf-8").split()
                a, b, c = super_kmers(words, k, m)
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                mins.append(a), firsts.append(b), runs.append(c)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(n, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(mins, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32())), pa.array(runs, pa.list_(pa.int32()))],
                names=[*KEY, "n_words", "sha", "mins", "firsts", "runs"],
            )

    return scan


def _flagged(scanned: DataFrame, hot: int) -> DataFrame:
    """Row id and the indexes of super-k-mers whose minimiser is chosen elsewhere too; hot ones apart."""
    each = scanned.select("rid", F.posexplode("mins").alias("i", "mini"))
    often = written(each.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    found = each.join(often.select("mini", (F.col("n") > hot).alias("hot")).hint("merge"), "mini")
    return found.groupBy("rid").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("i"))).alias("plain"),
        F.collect_list(F.when(F.col("hot"), F.col("i"))).alias("hot"),
    )


def _packed(words: list[bytes], first: int, run: int, k: int) -> bytes:
    return b" ".join(words[first : first + run + k - 1])


def _strings(k: int, instances: bool):
    """Packed strings of the super-k-mers: combined within a slice of rows, or one row each with their digest."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            seen: Counter = Counter()
            out: list[tuple] = []
            for doc_id, key, text, mins, firsts, runs in zip(
                *(rows.column(c).to_pylist() for c in (*KEY, "text", "mins", "firsts", "runs")), strict=True
            ):
                words = text.encode("utf-8").split()
                for mini, first, run in zip(mins, firsts, runs, strict=True):
                    packed = _packed(words, first, run, k)
                    if instances:
                        out.append((doc_id, key, first, xxhash.xxh3_128_digest(packed)))
                    else:
                        seen[mini, packed] += 1
            if instances:
                a, b, c, d = zip(*out, strict=True) if out else ((),) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.binary())],
                    names=[*KEY, "first", "digest"],
                )
            else:
                pairs = list(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary()),
                     pa.array([seen[p] for p in pairs], pa.int64())],
                    names=["mini", "packed", "n"],
                )

    return pack


LEVEL = "doc_id bigint, text_key bigint, text string, mins array<bigint>, firsts array<int>, runs array<int>"


def _split(k: int, m: int, seed: int):
    """Super-k-mers cut up by a further minimiser of their windows; both minimisers are their key."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            mins, firsts, runs = [], [], []
            for text, keys, begins, lengths in zip(*(rows.column(c).to_pylist() for c in ("text", "mins", "firsts", "runs")), strict=True):
                words = text.encode("utf-8").split()
                found = [(key, begin, super_kmers(words[begin : begin + run + k - 1], k, m, seed)) for key, begin, run in zip(keys, begins, lengths, strict=True)]
                both = [((a.view(np.uint64) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * MIX).view(np.int64) for key, _, (a, _, _) in found]
                mins.append(np.concatenate(both)), firsts.append(np.concatenate([b + begin for _, begin, (_, b, _) in found]))
                runs.append(np.concatenate([c for _, _, (_, _, c) in found]))
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in (*KEY, "text")), pa.array(mins, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int32())),
                 pa.array(runs, pa.list_(pa.int32()))],
                names=[*KEY, "text", "mins", "firsts", "runs"],
            )

    return split


def repeated_windows(strings: dict[bytes, int], k: int) -> dict[bytes, list[int]]:
    """Of the packed strings of one minimiser and their counts: which windows of each are found twice or more."""
    if len(strings) == 1:
        ((packed, n),) = strings.items()
        return {packed: list(range(packed.count(b" ") + 2 - k))} if n > 1 else {}
    windows = []
    for packed, n in strings.items():
        ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 32).tolist()
        begin = 0
        for start in range(len(ends) - k + 1):
            windows.append((packed[begin : ends[start + k - 1]], n, packed, start))
            begin = ends[start] + 1
    windows.sort()
    found: dict[bytes, list[int]] = {}
    at = 0
    while at < len(windows):
        stop = at + 1
        while stop < len(windows) and windows[stop][0] == windows[at][0]:
            stop += 1
        if stop - at > 1 or windows[at][1] > 1:
            for _, _, packed, start in windows[at:stop]:
                found.setdefault(packed, []).append(start)
        at = stop
    return found


def _buckets(k: int):
    """Reads a partition sorted by minimiser; holds the distinct strings of one minimiser at a time."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(strings):
            return [(xxhash.xxh3_128_digest(p), s) for p, s in repeated_windows(strings, k).items()]

        def batch(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.list_(pa.int32()))],
                names=["digest", "starts"],
            )

        current, strings, out = None, {}, []
        for rows in batches:
            for mini, packed, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if mini != current:
                    if strings:
                        out += settled(strings)
                    current, strings = mini, {}
                strings[packed] = strings.get(packed, 0) + n
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
        if strings:
            out += settled(strings)
        yield batch(out)

    return sort


def _remove(k: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            n, gone, kept = [], [], []
            for text, starts in zip(rows.column("text").to_pylist(), rows.column("starts").to_pylist(), strict=True):
                words = text.encode("utf-8").split()
                covered = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(starts or [], np.int64))
                covered[at] += 1
                covered[at + k] -= 1
                inside = np.cumsum(covered)[:-1] > 0
                left = b" ".join([w for w, x in zip(words, inside.tolist(), strict=True) if not x])
                n.append(len(words)), gone.append(int(inside.sum())), kept.append(left.decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("text_key"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.string())],
                names=[*KEY, "n_words", "n_removed", "kept"],
            )

    return remove


def _picked(indexes: str) -> list[Column]:
    def those(values: str) -> Column:
        return F.transform(indexes, lambda i: F.element_at(values, i + 1)).alias(values)

    return [those("mins"), those("firsts"), those("runs")]


def _marked(docs: DataFrame, k: int, m: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """All rows scanned (n_words, SHA-256 of the words), and the texts with repeated windows with those windows' starts."""
    spark = docs.sparkSession
    schema = "doc_id bigint, text_key bigint, n_words bigint, sha string, mins array<bigint>, firsts array<int>, runs array<int>"
    scanned = _keyed(docs).mapInArrow(_scan(k, m), schema)
    scanned = written(scanned.withColumn("rid", F.monotonically_increasing_id()))
    flagged = written(_flagged(scanned, hot))
    facts = scanned.select("rid", *KEY, "mins", "firsts", "runs").join(flagged.hint("merge"), "rid").drop("rid").dropDuplicates(KEY)
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.text_key") == F.col("b.text_key")]
    own = written(
        _keyed(docs).alias("a").join(facts.hint("merge").alias("b"), same).select("a.*", "mins", "firsts", "runs", "plain", "hot")
    )
    settled = own.filter("size(plain) > 0").select(*KEY, "text", *_picked("plain"))
    crowded = own.filter("size(hot) > 0").select(*KEY, "text", *_picked("hot"))
    places, seed = _places(crowded), 1
    while places:
        split = written(crowded.mapInArrow(_split(k, m, seed), LEVEL).withColumn("rid", F.monotonically_increasing_id()))
        flagged = written(_flagged(split, hot))
        both = split.join(flagged.hint("merge"), "rid")
        parted = both.filter("size(plain) > 0").select(*KEY, "text", *_picked("plain"))
        crowded = both.filter("size(hot) > 0").select(*KEY, "text", *_picked("hot"))
        settled, before = settled.unionByName(parted), places
        places, seed = _places(crowded), seed + 1
        if 10 * places > 9 * before:  # what is left has the same strings, by and large
            break
    if places:
        settled = settled.unionByName(crowded)
    parts = spread_parts(spark, scanned.count(), 20_000)
    strings = settled.mapInArrow(_strings(k, False), "mini bigint, packed binary, n bigint")
    found = strings.repartition(parts, "mini").sortWithinPartitions("mini").mapInArrow(_buckets(k), "digest binary, starts array<int>")
    # Repeated rows say the same once.
    placed = settled.mapInArrow(_strings(k, True), "doc_id bigint, text_key bigint, first int, digest binary").distinct()
    starts = (
        placed.join(written(found).hint("merge"), "digest")
        .select(*KEY, F.transform("starts", lambda s: s + F.col("first")).alias("starts"))
        .groupBy(*KEY)
        .agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    marked = own.select(*KEY, "text").alias("a").join(starts.hint("merge").alias("b"), same).select("a.*", "starts")
    return scanned, marked


def _places(crowded: DataFrame) -> int:
    """At how many places hot super-k-mers are."""
    return crowded.agg(F.sum(F.size("firsts"))).first()[0] or 0


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 6, hot: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Words kept of each text in which a window also starts elsewhere, and the scan of all rows.

    The first has doc_id, text_key, n_words, n_removed and kept; the second doc_id,
    text_key, n_words and sha.
    """
    scanned, marked = _marked(docs, k, m, hot)
    kept = marked.mapInArrow(_remove(k), "doc_id bigint, text_key bigint, n_words bigint, n_removed bigint, kept string")
    return kept, scanned.select(*KEY, "n_words", "sha")


def removal_digests(docs: DataFrame, **settings: int) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the words kept, joined by one space."""
    with small_batches(docs.sparkSession):
        kept, scanned = remove_repeats(docs, **settings)
        changed = written(kept.select(*KEY, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.text_key") == F.col("b.text_key")]
    others = scanned.alias("a").join(changed.hint("merge").alias("b"), same, "left_anti").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256")
    )
    return others.unionByName(changed.drop("text_key"))


def without_repeats(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs``, with all their columns; texts with repeats become the words kept, joined by one space."""
    with small_batches(docs.sparkSession):
        kept, _ = remove_repeats(docs, **settings)
        new = written(kept.select(*KEY, "kept").dropDuplicates(KEY))
    own = docs.alias("a")  # no column is added, so none can clash
    key = F.xxhash64(F.coalesce("a.text", F.lit("")))
    same = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), key == F.col("b.text_key")]
    joined = own.join(new.hint("merge").alias("b"), same, "left")
    return joined.select(*[F.coalesce("b.kept", "a.text").alias(c) if c == "text" else F.col(f"a.`{c}`") for c in docs.columns])
