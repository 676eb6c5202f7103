"""Alignment of two tokenizers' tokens by the byte offsets where tokens of both end.

Each tokenizer's tokens get their cumulative ends in bytes, kept in a dictionary from
end to index. The intersection of the two key sets, sorted, slices both id lists into
groups; inside a slice no further ends meet, so a slice gives one link, between its
last tokens. Corpus-wide counts of linked id pairs then judge every link.

Both tokenizers cut before a space or line break between two other characters: the
rules of the byte-level one say so, and no entry of the other's vocabulary holds a
space or a line break behind another character (asked of the vocabulary when it is
loaded). So texts are taken chunk by chunk between such places, and a chunk met before
is not encoded again. Texts with characters that Unicode versions judge differently are
one chunk, encoded by the libraries as a whole.

Counting at scale: a page, some 8 MB of texts, keeps its texts as numbers of chunks and
its chunks as numbers of id pairs. It sends its distinct pairs with their counts to parts
by the second id, packed, so a part knows the highest count of each of its ids; then it
asks the parts for its own pairs. What travels follows distinct pairs of pages, never
links, and no pair is a key that gathers documents: frequent pairs are one entry a page.

Defined cases: a text that is null or empty, or whose tokens do not give back its bytes,
has no tokens, zeros everywhere and ''; rows with equal or null ids are counted and
returned each; texts may be of any length, memory follows the longest; an empty table
gives an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property
from itertools import accumulate, chain, count, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.bpe import byte_letters
from atticsweep.llm.common import rows_of, spread_parts, texts
from atticsweep.llm.packing import SETTLED
from atticsweep.session import written

PAGE = 8 << 20  # bytes of text
PART = 64 << 20  # bytes of text for one part of the pairs
BLOCK = 20_000  # chunks that are aligned in one go
MOST_PARTS = 512  # more parts would only cut the pages' pairs finer
# Between the cuts: a break belongs to the chunk behind it, longer white space stays inside.
CHUNK = re.compile(r"\s*\S+(?:(?:\s{2,}|[^\S \n])\S+)*(?:\s+\Z)?|\s+\Z")
# The same for texts whose breaks are all single.
PLAIN, OTHER_BREAKS = re.compile(r"[ \n]\S+"), re.compile(r"\s\s|[^\S \n]|\s\Z")
SPACE = "▁"

ROWS = "kind int, part bigint, page bigint, a binary, b binary, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string"
PACKED = "kind int, part bigint, page bigint, a binary, b binary"
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

Group = tuple[Sequence[int], Sequence[int]]


def meets(a_sizes: Iterable[int], b_sizes: Iterable[int]) -> tuple[list[int], list[int]]:
    """How many tokens of each side lie before every end that both have; the sizes are those of the tokens, in bytes."""
    at_a, at_b = (dict(zip(accumulate(sizes), count(1))) for sizes in (a_sizes, b_sizes))
    common = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, common)), list(map(at_b.__getitem__, common))


def groups(a: Sequence[int], b: Sequence[int], a_sizes: Sequence[int], b_sizes: Sequence[int]) -> list[Group]:
    """Both id lists cut where tokens of both end; the sizes are those of every id, in bytes."""
    ends_a, ends_b = meets(map(a_sizes.__getitem__, a), map(b_sizes.__getitem__, b))
    return [(a[i:p], b[j:q]) for i, p, j, q in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]


class Tokenizers:
    """The byte-level tokenizer (A) and the piece tokenizer (B), without special tokens."""

    def __init__(self, a_vocabulary: str | None = None, a_ranks: str | None = None, b_model: str | None = None):
        import base64

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ordinary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.a_path, self.slow = a_vocabulary or public_tokenizers.path("byte_bpe_50k.json"), None
        self.a_bytes: list[bytes] = self._bytes_of_a()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_model or public_tokenizers.path("piece_bpe_32k.model"))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b_bytes = [
            bytes([int(name[3:5], 16)]) if self.pieces.is_byte(i) else name.replace(SPACE, " ").encode() for i, name in enumerate(names)
        ]
        self.a_sizes, self.b_sizes = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        ordinary = [n for i, n in enumerate(names) if not (self.pieces.is_control(i) or self.pieces.is_unknown(i) or self.pieces.is_byte(i))]
        self.cuts = not any("\n" in n or SPACE in n.lstrip(SPACE) for n in ordinary)

    def _library(self):
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.a_path)
            self.slow.no_padding()
            self.slow.no_truncation()
            self.slow.encode_special_tokens = True
        return self.slow

    def _bytes_of_a(self) -> list[bytes]:
        letters = {letter: byte for byte, letter in enumerate(byte_letters())}
        found = self._library().get_vocab(with_added_tokens=True)
        out = [b""] * (max(found.values()) + 1)
        for token, i in found.items():
            # Only an added token has letters that stand for no byte; it is never given out here.
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out

    def chunks(self, text: str) -> list[str]:
        """The text behind one space, cut where both tokenizers cut."""
        if self.cuts and (text.isascii() or not SETTLED.search(text)):
            text = f" {text}"
            return (CHUNK if OTHER_BREAKS.search(text) else PLAIN).findall(text)
        return [f" {text}"]

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of each chunk."""
        a = [
            self.fast.encode_ordinary(c) if c.isascii() or not SETTLED.search(c) else self._library().encode(c, add_special_tokens=False).ids
            for c in chunks
        ]
        # The model puts a space in front. Before a line break, which no entry holds, that space is one token.
        b = self.pieces.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return a, [ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, b, strict=True)]

    def same(self, chunk: str, a: list[int], b: list[int]) -> bool:
        want = chunk.encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))

    def groups(self, text: str) -> list[Group]:
        """The groups of a text; none where its tokens do not give its bytes back."""
        chunks = self.chunks(text) if text else []
        found = list(zip(chunks, *self.ids(chunks), strict=True))
        if not all(self.same(*x) for x in found):
            return []
        return [group for _, a, b in found for group in groups(a, b, self.a_sizes, self.b_sizes)]

    @cached_property
    def _shown(self) -> pa.Array:
        """How ids are written: those of A, each with a comma or as its group's last, then those of B."""
        sides = ((len(self.a_bytes), "|"), (len(self.b_bytes), ";"))
        return pa.array([f"{i}{end}" for n, last in sides for i in range(n) for end in (",", last)], pa.large_binary())

    def aligned(self, chunks: list[str]) -> list[tuple[int, int, int, bytes, bytes, bool]]:
        """Of each chunk: numbers of ids and groups, the groups as text, the linked pairs as codes, whether its bytes come back.

        All chunks are aligned in one go, as if they were one text: each ends where tokens of both end.
        """
        ids = list(zip(*self.ids(chunks), strict=True))
        good = [self.same(chunk, *its) for chunk, its in zip(chunks, ids, strict=True)]
        n_a, n_b = (np.array([len(its[k]) if ok else 0 for its, ok in zip(ids, good, strict=True)], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(its[k] for its, ok in zip(ids, good, strict=True) if ok), np.int64) for k in (0, 1))
        ends_a, ends_b = (np.array(x, np.int64) for x in meets(map(self.a_sizes.__getitem__, a.tolist()), map(self.b_sizes.__getitem__, b.tolist())))
        # A slice gives one link, between its last tokens: no other ends of it meet.
        codes = (a[ends_a - 1] << 32 | b[ends_b - 1]).astype(np.uint64)
        # A token is written behind all tokens of earlier groups, and behind its group's A tokens if it is of B.
        group_a, group_b = np.searchsorted(ends_a, np.arange(len(a)), side="right"), np.searchsorted(ends_b, np.arange(len(b)), side="right")
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[ends_a - 1] = last_b[ends_b - 1] = 1
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate([[0], ends_b])[group_a]] = 2 * a + last_a
        order[np.arange(len(b)) + np.concatenate([ends_a, [0]])[group_b]] = 2 * (len(self.a_bytes) + b) + last_b
        written_ids = self._shown.take(pa.array(order))
        text, starts = written_ids.buffers()[2], np.frombuffer(written_ids.buffers()[1], np.int64)
        text = text.to_pybytes() if text is not None else b""
        to_text = starts[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        to_group = np.concatenate([[0], np.searchsorted(ends_a, np.cumsum(n_a), side="right")])
        packed, to_code = codes.tobytes(), (8 * to_group).tolist()
        sizes = zip(n_a.tolist(), n_b.tolist(), np.diff(to_group).tolist(), strict=True)
        return [
            (*size, text[t : max(t, u - 1)], packed[c:d], ok)
            for size, (t, u), (c, d), ok in zip(sizes, pairwise(to_text), pairwise(to_code), good, strict=True)
        ]


class Known:
    """Chunks aligned before, by their text; forgotten all at once beyond ``most`` bytes, about."""

    def __init__(self, tokenizers: Tokenizers, most: int = 96 << 20, longest: int = 64):
        self.tokenizers, self.most, self.longest = tokenizers, most, longest
        self.entries: dict[str, tuple] = {}
        self.held = 0

    def look_up(self, chunks: list[str]) -> list[tuple[int, int, int, bytes, bytes, bool]]:
        """What ``Tokenizers.aligned`` says of each chunk."""
        new = [c for c in chunks if c not in self.entries]
        made = {}
        for i in range(0, len(new), BLOCK):
            made |= dict(zip(new[i : i + BLOCK], self.tokenizers.aligned(new[i : i + BLOCK]), strict=True))
        out = [made[c] if c in made else self.entries[c] for c in chunks]
        if self.held > self.most:
            self.entries, self.held = {}, 0
        for chunk, entry in made.items():
            if len(chunk) <= self.longest:
                self.entries[chunk] = entry
                self.held += 260 + len(chunk) + len(entry[3]) + len(entry[4])
        return out


class Page(dict):
    """Numbers of the chunks of a page, in the order of their first occurrence."""

    def __missing__(self, chunk: str) -> int:
        self[chunk] = number = len(self)
        return number


def _records(rows: list[tuple], schema: str = ROWS) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for rows in batches:
        for i in range(rows.num_rows):
            yield tuple(c[i].as_py() for c in rows.columns)


def _page_rows(entries: list[tuple], docs: list[tuple], parts: int, number: int) -> list[tuple]:
    """The page's pairs by part, its chunks as numbers of pairs, and its rows."""
    sizes = np.array([len(e[4]) // 8 for e in entries], np.uint32)
    codes = np.frombuffer(b"".join(e[4] for e in entries), np.uint64)
    met = np.zeros(len(entries), np.int64)
    for *_, uses in docs:
        np.add.at(met, uses, 1)
    part = (codes & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
    order = np.lexsort((codes, part))
    first = np.ones(len(order), bool)
    first[1:] = codes[order][1:] != codes[order][:-1]
    place = np.empty(len(order), np.uint32)
    place[order] = np.cumsum(first) - 1
    distinct, its_part = codes[order][first], part[order][first]
    counts = np.bincount(place, np.repeat(met, sizes), len(distinct)).astype(np.uint64)
    out, none = [], (None,) * 5
    names, starts = np.unique(its_part, return_index=True)
    for p, c, n in zip(names.tolist(), np.split(distinct, starts)[1:], np.split(counts, starts)[1:], strict=True):
        out.append((0, p, number, c.tobytes(), n.tobytes(), *none))
    out.append((1, None, number, sizes.tobytes(), place.tobytes(), *none))
    return out + [(2, None, number, uses.tobytes(), None, *facts) for *facts, uses in docs]


def _scan(parts: int, vocabularies: dict):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 32, None
        for rows in rows_of(batches, PAGE):
            known = known or Known(Tokenizers(**vocabularies))
            page = Page()
            uses = [
                np.array(list(map(page.__getitem__, known.tokenizers.chunks(text))) if text else [], np.uint32)
                for text in rows.column("text").to_pylist()
            ]
            entries = known.look_up(list(page))
            facts = np.array([e[:3] for e in entries], np.int64).reshape(-1, 3)
            bad = np.array([not e[5] for e in entries], bool)
            cuts = [e[3] for e in entries]
            docs = []
            for doc_id, its in zip(rows.column("doc_id").to_pylist(), uses, strict=True):
                if bad[its].any():
                    its = its[:0]
                digest = hashlib.sha256(b";".join(map(cuts.__getitem__, its.tolist()))).hexdigest() if len(its) else ""
                docs.append((doc_id, *facts[its].sum(axis=0).tolist(), digest, its))
            yield _records(_page_rows(entries, docs, parts, number))
            number += 1

    return scan


def _added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, inverse = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
    counts = np.zeros(len(codes), np.uint64)
    np.add.at(counts, inverse, np.concatenate([p[1] for p in pieces]))
    return codes, counts


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by part: each part's pairs with their counts and whether that is their second id's highest."""

    def total(part: int, pieces: list) -> pa.RecordBatch:
        codes, counts = _added(pieces)
        _, b = np.unique(codes & np.uint64(0xFFFFFFFF), return_inverse=True)
        highest = np.zeros(b.max() + 1, np.uint64)
        np.maximum.at(highest, b, counts)
        # The lowest bit says whether the count is the highest.
        return _records([(0, part, -1, codes.tobytes(), (counts << np.uint64(1) | (counts == highest[b])).tobytes())], PACKED)

    current, waiting, held = None, [], 0
    for _, part, _, a, b in _each(batches):
        if part != current and waiting:
            yield total(current, waiting)
            waiting, held = [], 0
        current = part
        waiting.append((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
        # Pairs are added up before they are twice what is distinct among them.
        if sum(len(w[0]) for w in waiting) > 2 * held + 500_000:
            waiting = [_added(waiting)]
            held = len(waiting[0][0])
    if waiting:
        yield total(current, waiting)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part and page, the part's own row first: what the part knows of each page's pairs, page by page."""
    codes = values = np.empty(0, np.uint64)
    for _, part, page, a, b in _each(batches):
        if page < 0:
            codes, values = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        else:
            yield _records([(0, part, page, None, values[np.searchsorted(codes, np.frombuffer(a, np.uint64))].tobytes())], PACKED)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by page: the answers by part, the page's chunks, its rows."""
    answers: list[np.ndarray] = []
    sums = best = np.empty(0, np.int64)
    for rows in batches:
        out = []
        for kind, _, _, a, b, doc_id, n_a, n_b, n_groups, digest in _each([rows]):
            if kind == 0:
                answers.append(np.frombuffer(b, np.uint64))
            elif kind == 1:
                values = np.concatenate([*answers, np.empty(0, np.uint64)])[np.frombuffer(b, np.uint32)]
                answers = []
                chunk = np.repeat(np.arange(len(a) // 4), np.frombuffer(a, np.uint32))
                sums, best = np.zeros(len(a) // 4, np.int64), np.zeros(len(a) // 4, np.int64)
                np.add.at(sums, chunk, (values >> np.uint64(1)).astype(np.int64))
                np.add.at(best, chunk, (values & np.uint64(1)).astype(np.int64))
            else:
                uses = np.frombuffer(a, np.uint32)
                out.append((doc_id, n_a, n_b, n_groups, n_groups, int(best[uses].sum()), int(sums[uses].sum()), digest))
        if out:
            yield _records(out, RESULT)


def alignment(docs: DataFrame, **vocabularies: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``vocabularies`` are other files: ``a_vocabulary`` and ``a_ranks`` (the same
    vocabulary twice) and ``b_model``.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(spread_parts(spark, size, PART), MOST_PARTS)
    gathered = written(texts(docs).mapInArrow(_scan(parts, vocabularies), ROWS))
    asked = gathered.filter("kind = 0").select("kind", "part", "page", "a", "b")
    totals = written(asked.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_totals, PACKED))
    met = totals.unionByName(asked.withColumn("b", F.lit(None).cast("binary")))
    answers = written(met.repartition(parts, "part").sortWithinPartitions("part", "page").mapInArrow(_answers, PACKED))
    rows = gathered.filter("kind > 0").unionByName(answers, allowMissingColumns=True)
    pages = spread_parts(spark, size, PAGE)
    return rows.repartition(pages, "page").sortWithinPartitions("page", "kind", "part").mapInArrow(_finish, RESULT)


def aligned_groups(docs: DataFrame, **vocabularies: str) -> DataFrame:
    """Per row: doc_id and its groups, an array of the two id arrays; a row without tokens has none."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = None
        ids = pa.list_(pa.int32())
        kind = pa.list_(pa.struct([("a", ids), ("b", ids)]))
        for rows in rows_of(batches, PAGE):
            tokenizers = tokenizers or Tokenizers(**vocabularies)
            found = [[{"a": a, "b": b} for a, b in tokenizers.groups(text)] for text in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found, kind)], names=["doc_id", "groups"])

    return texts(docs).mapInArrow(cut, "doc_id bigint, groups array<struct<a: array<int>, b: array<int>>>")
