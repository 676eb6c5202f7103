"""Token alignment against the libraries on whole texts and a count of all links."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import text_helpers as H
from tokenizers import Tokenizer

from atticsweep.llm import align

ODD = [
    "a  b", "a \n b", "a\nb c\n", "  x", "\n", "\t a\tb", "it's  ok\n\nnew line. \n", "<s>a</s> [INST] <0x41>", "<|endoftext|> x <unk>",
    "日本 語です。 は\nü", "a\x00b", "x\x1cy\x85 z", " ", "a▁b c", "▁", "ﬁ 　 x", "it's I'LL x ᠎ y", "q" * 5000, "ab " * 3000, "é‍👩‍👧 x\n y",
]


def brute(rows):
    """Whole texts by the libraries, ends as sets, and every link counted."""
    a_library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    b_library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = align.Tokenizers()
    found, counts = [], Counter()
    for doc_id, text, *_ in rows:
        a = a_library.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_library.encode(text) if text else []
        joined = [b"".join(map(table.__getitem__, ids)) for table, ids in ((own.a_bytes, a), (own.b_bytes, b))]
        if not text or joined != [(" " + text).encode()] * 2:
            found.append((doc_id, 0, 0, [], []))
            continue
        ends = []
        for ids, table in ((a, own.a_bytes), (b, own.b_bytes)):
            total, its = 0, []
            for i in ids:
                total += len(table[i])
                its.append(total)
            ends.append(its)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for end in common:
            p, q = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        places = defaultdict(list)
        for y, end in zip(b, ends[1], strict=True):
            places[end].append(y)
        links = [(x, y) for x, end in zip(a, ends[0], strict=True) for y in places[end]]
        counts.update(links)
        found.append((doc_id, len(a), len(b), groups, links))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for doc_id, n_a, n_b, groups, links in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(text.encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(map(counts.__getitem__, links)), digest))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def all_rows(rows):
    return [*rows, *((1000 + i, text, "en", "odd", 0) for i, text in enumerate(ODD)), *((2000, text, "en", "odd", 0) for text in ODD[:3] * 2)]


def test_as_whole_texts_counted(spark, all_rows):
    assert H.result(align.alignment(H.frame(spark, all_rows))) == brute(all_rows)


def test_pages_and_parts_do_not_change_the_counts(spark, all_rows, monkeypatch):
    monkeypatch.setattr(align, "PAGE", 4000)
    monkeypatch.setattr(align, "PART", 9000)
    assert H.result(align.alignment(H.frame(spark, all_rows).repartition(2))) == brute(all_rows)


def test_a_byte_that_a_vocabulary_cannot_give_back(spark):
    """U+2581 comes back as a space: such a text has no tokens, and its other chunks count nowhere."""
    rows = [(1, "one two", None, None, 0), (2, "one two ▁", None, None, 0), (3, "▁", None, None, 0)]
    got = {r.doc_id: r for r in align.alignment(H.frame(spark, rows)).collect()}
    assert got[2][1:] == got[3][1:] == (0, 0, 0, 0, 0, 0, "")
    assert got[1].count_sum == got[1].n_links == got[1].n_best > 0


def test_groups_give_back_all_ids(docs, rows, empty):
    own = align.Tokenizers()
    want = {i: text or "" for i, text, *_ in rows}
    for doc_id, groups in align.aligned_groups(docs).collect():
        for g in groups:
            assert b"".join(own.a_bytes[i] for i in g.a) == b"".join(own.b_bytes[i] for i in g.b)
        whole = b"".join(own.a_bytes[i] for g in groups for i in g.a)
        assert whole == (f" {want[doc_id]}".encode() if want[doc_id] else b"")
    assert align.alignment(empty).count() == align.aligned_groups(empty).count() == 0


def test_chunks_forgotten_are_aligned_again():
    known = align.Known(align.Tokenizers(), most=2000)
    words = [f" word{i}" for i in range(20)]
    first = [known.look_up([w])[0] for w in words]
    assert len(known.entries) < 20 and known.look_up(words) == first
    long = " " + "x" * 100
    assert known.look_up([long])[0][0] > 0 and long not in known.entries


def test_every_code_point_is_aligned_or_refused():
    """No code point, alone or between letters, gives other ids than the libraries give the whole text."""
    own, a_library = align.Tokenizers(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_library.encode_special_tokens = True
    points = [c for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [0x4E00, 0x9FA5, 0xAC00, 0xFEFF, 0xFF01, 0x1F600, 0x1F468, 0x20000]
    for c in map(chr, points):
        text = f"a{c}b {c} x\n{c}{c}"
        chunks = own.chunks(text)
        assert "".join(chunks) == f" {text}"
        a, b = ([i for ids in side for i in ids] for side in own.ids(chunks))
        assert a == a_library.encode(f" {text}", add_special_tokens=False).ids, hex(ord(c))
        assert b == own.pieces.encode(text), hex(ord(c))
