"""Byte-pair encoding by a priority queue of merge ranks over a doubly linked symbol list.

``encode_texts`` runs where the texts are: no shuffle, one task's memory holds a
slice of rows and a bounded store of words already merged. A word's symbols form a
linked list; the queue holds (rank, position) of adjacent pairs. An entry whose
symbols have changed since it was pushed is stale and skipped when popped.

Lower case, composition and the classes of the split pattern follow a Unicode version.
Texts with characters outside ``SETTLED``, on which versions agree, take their words from
the tokenizer file's own normaliser and splitter; the merges are made here all the same.

Defined cases: a null or empty text has no tokens and decodes to the empty text;
texts may be of any length; repeated rows give repeated results; an empty table
gives an empty one; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atticsweep.llm.common import rows_of, texts

# Fixed values of the word_bpe tokenizer: its split pattern and the two strings that stand for one token each.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = regex.compile(r"[\x1c-\x1f]")
# Any other character than those of scripts that no Unicode version has changed for long.
UNSETTLED = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏͰ-ͷͺ-ͿΑ-ΡΣ-ӿ"
                       "‐-‧‰-⁞€ぁ-ゖ一-龥]")
SCHEMA = "doc_id bigint, n_tokens bigint, ids string, decoded string"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The visible character of each byte: itself where printable in Latin-1, else the next one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(hidden)) for b in range(256)]


class WordBpe:
    """The vocabulary and merge ranks of a tokenizer file with word ends, and words already encoded."""

    def __init__(self, path: str, keep: int = 96 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        # Rank of a pair of ids, the pair held in one number; the id that each rank makes.
        self.rank_of = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update((i, s) for s, i in self.special.items())
        self.digits = {i: str(i) for i in self.names}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.path, self.library = path, None
        self.byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.keep, self.held = keep, 0  # bytes of words already encoded, about
        self.ids_text = _Learnt(self)
        self.decoded: dict[str, str] = {}

    def merged(self, word: str) -> list[int]:
        """The ids of one word."""
        return self.merged_bytes(word.encode("utf-8"))

    def merged_bytes(self, data: bytes) -> list[int]:
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        rank_of, made = self.rank_of.get, self.made
        # The rank of each symbol with its right neighbour, as of now; -1 if they never merge.
        ranks = [rank_of(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]
        ranks.append(-1)
        queue = [rank << 32 | i for i, rank in enumerate(ranks) if rank >= 0]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            if ranks[i] != entry >> 32:  # stale: the pair that was pushed is no longer there
                continue
            j = after[i]
            new = ids[i] = made[entry >> 32]
            ids[j] = ranks[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks[i] = rank_of(new << 32 | ids[k], -1)
                if rank >= 0:
                    push(queue, rank << 32 | i)
            else:
                ranks[i] = -1
            h = before[i]
            if h >= 0:
                rank = ranks[h] = rank_of(ids[h] << 32 | new, -1)
                if rank >= 0:
                    push(queue, rank << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after another; this tokenizer's decoder puts a space between them."""
        names = self.names
        return " ".join([names[i] for i in ids])

    def chunks(self, text: str) -> list[str]:
        """Runs without white space of text without special strings: composed, each letter lower-cased by itself."""
        if text.isascii():
            lowered = text.lower()
        else:
            lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # str.split() also splits at four control characters that are no white space to the tokenizer.
        return SPACES.split(lowered) if SEPARATORS.search(lowered) else lowered.split()

    def library_words(self, text: str) -> list[bytes]:
        """The words of a text as the tokenizer file's normaliser and splitter give them."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        pieces = self.library.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in pieces if piece]

    def encode(self, text: str) -> tuple[str, str]:
        """The decimal ids joined by spaces, and the decoded text."""
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        ids, decoded = [], []
        for part in parts:
            if part in self.special:
                ids.append(str(self.special[part]))
                decoded.append(part)
                continue
            if not part.isascii() and UNSETTLED.search(part):
                for data in self.library_words(part):
                    own = self.merged_bytes(data)
                    ids.append(" ".join([self.digits[i] for i in own]))
                    decoded.append(self.decode(own))
                continue
            chunks = [c for c in self.chunks(part) if c]
            ids.extend(map(self.ids_text.__getitem__, chunks))
            decoded.extend(map(self.decoded.__getitem__, chunks))
        if self.held > self.keep:
            self.ids_text.clear()
            self.decoded.clear()
            self.held = 0
        return " ".join(ids), " ".join(decoded)


class _Learnt(dict):
    """The ids of each run without white space met, as text; a new one is split, merged and decoded on first sight.

    No word of the split pattern spans white space.
    """

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe

    def __missing__(self, chunk: str) -> str:
        bpe = self.bpe
        if chunk.isalpha():  # one word, as nearly all are
            ids = bpe.merged(chunk)
            bpe.decoded[chunk] = bpe.decode(ids)
            text = " ".join([bpe.digits[i] for i in ids])
        else:
            words = bpe.words.findall(chunk)
            if len(words) == 1:
                ids = bpe.merged(chunk)
                bpe.decoded[chunk] = bpe.decode(ids)
                text = " ".join([bpe.digits[i] for i in ids])
            else:
                text = " ".join([self[w] for w in words])
                bpe.decoded[chunk] = " ".join([bpe.decoded[w] for w in words])
        self[chunk] = text
        bpe.held += 300 + 4 * len(chunk) + len(text) + len(bpe.decoded[chunk])
        return text


def _encoder(path: str | None, digests: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for rows in rows_of(batches):
            if bpe is None:
                bpe = WordBpe(path or _default_path())
            out = [bpe.encode(t) for t in rows.column("text").to_pylist()]
            ids, decoded = [a for a, _ in out], [b for _, b in out]
            counts = [a.count(" ") + 1 if a else 0 for a in ids]
            if digests:
                ids = [hashlib.sha256(a.encode()).hexdigest() for a in ids]
                decoded = [hashlib.sha256(b.encode()).hexdigest() for b in decoded]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=[f.split()[0] for f in (DIGESTS if digests else SCHEMA).split(", ")],
            )

    return encode


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_texts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: n_tokens, the decimal ids joined by spaces, and the decoded text.

    ``vocabulary`` is the tokenizer file's path on the executors.
    """
    return texts(docs).mapInArrow(_encoder(vocabulary, False), SCHEMA)


def encoded_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """As ``encode_texts``, with SHA-256 digests made where the ids are, so that neither ids nor texts travel."""
    return texts(docs).mapInArrow(_encoder(vocabulary, True), DIGESTS)


def decode_ids(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id`` and the decoded text of ids joined by spaces; null or empty ids give the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = None
        for rows in rows_of(batches):
            bpe = bpe or WordBpe(vocabulary or _default_path())
            decoded = [bpe.decode([int(x) for x in ids.split()]) for ids in rows.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(decoded, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", F.coalesce("ids", F.lit("")).alias("ids")).mapInArrow(
        decode, "doc_id bigint, decoded string"
    )
