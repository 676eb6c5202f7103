"""Periodic runs against a comparison of every word with every other."""

import hashlib
import random
import zlib
from fractions import Fraction

import text_helpers as H

from atticsweep.llm import runs


def brute(words, least=24, times=3):
    """Every lag at every word, and no smaller period by trying all."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                part = words[i : i + size]
                if not any(part[:-e] == part[e:] for e in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    words = []
    for _ in range(rng.randint(0, 6)):
        size, letters = rng.randint(1, 30), rng.choice([1, 2, 3, 8, 100])
        period = [str(rng.randrange(letters)) for _ in range(size)]
        times = rng.randint(1, 6)
        words += (period * times)[: rng.randint(1, size * times)]
        if rng.random() < 0.3:
            words += [str(rng.randrange(1000)) for _ in range(rng.randint(0, 9))]
    return words


def test_all_runs_and_no_others():
    rng, met = random.Random(11), 0
    for _ in range(300):
        documents = [periodic(rng) for _ in range(rng.randint(1, 4))]
        least, times = rng.choice([(24, 3), (24, 3), (5, 3), (12, 4), (3, 3)])
        want = [brute(words, least, times) for words in documents]
        assert runs.find_runs(documents, least, times) == want
        met += sum(map(len, want))
    assert met > 500


def test_runs_inside_runs_and_over_long_texts():
    inner = (["a"] * 30 + ["b"] + ["a", "c"] * 13) * 4
    assert runs.find_runs([inner]) == [brute(inner)] and len(brute(inner)) > 4
    rng = random.Random(2)
    long = [str(rng.randrange(300)) for _ in range(200_000)]
    tail = long[1000:60_000] * 3
    found = runs.find_runs([long + tail])[0]
    assert (len(long) - 0, len(tail), 59_000) in found
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 900:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert runs.find_runs([list(fibonacci[-1])], 5) == [brute(list(fibonacci[-1]), 5)]


def test_segments_end_where_words_are_rare():
    words = ["x"] * 30 + ["once"] + ["y", "z"] * 20 + ["w", "w"]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    import numpy as np

    ids = np.array([number[w] for w in words])
    assert runs.split_segments(ids, np.array([0]), np.array([len(words)])) == [(0, 30), (31, 71)]


def test_two_repeats_are_refused():
    import pytest

    with pytest.raises(ValueError):
        runs.find_runs([["a"] * 50], 24, 2)


def expected(rows):
    out = []
    for doc_id, text, *_ in rows:
        words = H.words(text)
        n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words) if n < 1500 else None
        if found is None:
            found = runs.find_runs([words])[0]  # the long text; brute force on it is too slow
        dropped = {i for s, size, q in found for i in range(s + q, s + size)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        facts = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        out.append((doc_id, len(found), *facts, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_digests_of_the_planted_texts(spark, rows, empty):
    rng = random.Random(4)
    more = [(500 + i, " ".join(periodic(rng)), "en", "s", 0) for i in range(60)]
    assert H.result(runs.run_digests(H.frame(spark, rows + more))) == expected(rows + more)
    assert runs.run_digests(empty).count() == runs.without_runs(empty).count() == 0


def test_texts_without_their_repeats(spark):
    rows = [(1, "so  it " + "goes on " * 15 + "end", "en", "s", 0), (2, None, None, None, None), (3, "a b\tc", "en", "s", 0)]
    got = {r.doc_id: r for r in runs.without_runs(H.frame(spark, rows)).collect()}
    assert got[1].text == "so it goes on end" and [tuple(r) for r in got[1].runs] == [(2, 30, 2)]
    assert (got[2].text, got[2].runs) == ("", []) and got[3].text == "a b c"
