import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import text_helpers as H
from tokenizers import Tokenizer

from atticsweep.llm import bpe, packing


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_as_the_library(docs, rows, empty):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert H.result(bpe.encoded_digests(docs)) == sorted(want, key=repr)
    encoded = bpe.encode_texts(docs)
    assert H.result(bpe.decode_ids(encoded)) == H.result(encoded.select("doc_id", "decoded"))
    assert bpe.encoded_digests(empty).count() == 0


def test_bpe_of_odd_texts():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("<|startoftext|>a<|endoftext|>b <|x", "ΟΔΟΣ Σ İ ǅ", "a\x1cb\x85c d", "'s 'LL i'm", "é‍👩‍👧", "!" * 3000, "ﬁ ﷺ"):
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))


def test_bpe_of_every_code_point():
    """Between two letters, where composition, lower case and the split pattern may treat it differently."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    points = [*range(1, 0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 37)]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}B" for c in points[at : at + 20_000]]
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.encode(text)[0] == " ".join(map(str, want.ids)), ascii(text)


def test_bpe_store_is_bounded_by_bytes():
    own = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"), keep=200_000)
    held = []
    for i in range(40):
        own.encode(f"{'x' * 20_000}{i}")
        held.append(own.held)
    assert max(held) < 600_000 and 0 in held
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "x" * 3000 + " y" * 3000
    assert own.encode(text)[0].split() == [str(i) for i in library.encode(text, add_special_tokens=False).ids]


def test_packing_holds_every_id_once(docs, rows, empty):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, size=256)
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got.collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for start in range(0, len(ids), 256):
            piece = ids[start : start + 256]
            want[doc_id].append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    spent = packing.padding(got, 256).first()
    assert spent.padding <= 0.06 * spent.tokens
    assert packing.pack(empty).count() == 0


def test_tokens_of_odd_texts_as_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing.Tokenizer()
    for text in ("a<|endoftext|> b", "a\x85b \x1c c", "привет 你好 “q” – €", " \n\n x \t\t", "½² 　 ᚠ 𝒳", "it's I'LL"):
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_columns_reach_the_bound():
    """Pairs of lengths that fill a sequence only together: greedy patterns cannot, columns do."""
    lengths, demand = np.array([300, 301, 430, 431, 697, 723]), np.array([40, 40, 40, 40, 40, 40])
    _, count = packing.column_generation(lengths, demand, 1000, gap=1e-6)
    _, _, greedy = packing.greedy_basis(lengths, demand, 1000)
    assert count.sum() <= greedy.sum() + 1e-9
    found = packing.plan({int(n): 40 for n in lengths} | {1000: 3}, 1000)
    used = set()
    for length, n in [(int(x), 40) for x in lengths] + [(1000, 3)]:
        sequence, offset = found.place(length, np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            span = set((s, x) for x in range(o, o + length))
            assert o + length <= 1000 and not used & span
            used |= span
    assert found.sequences <= np.ceil(count.sum()) + 8
