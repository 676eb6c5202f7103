import math
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import text_helpers as H
from pyspark.sql import functions as F

from atticsweep.llm import ctw, html, language_id, quality, toxicity


def test_context_tree_and_word_model(docs, rows, empty):
    tokens = [(r[0], H.lowered(r[1]).encode().split() + [b"\n"]) for r in rows]
    seen = Counter(w for i, ws in tokens if H.held(i, 10) for w in ws)
    n, v = sum(seen.values()), len(seen)
    got = {(r.doc_id, r.n_tokens): r for r in ctw.score_texts(docs, depth=3).collect()}
    assert sum(1 for _ in rows) == ctw.score_texts(docs, depth=0).count()
    for doc_id, ws in tokens:
        r = got[doc_id, len(ws)]
        base = sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert (r.held_out, r.n_known, r.train_tokens) == (H.held(doc_id, 10) == 0, sum(seen[w] > 0 for w in ws), n)
        assert r.score < 0
    assert ctw.score_texts(empty).count() == 0


def direct_ctw(train, text, depth):
    """Node by node, with dictionaries and recursion."""
    nodes = Counter()
    for data in train:
        data = b"\n" * depth + data
        for t in range(depth, len(data)):
            for bit in range(8):
                j, value = (1 << bit) | (data[t] >> (8 - bit)), data[t] >> (7 - bit) & 1
                for d in range(depth + 1):
                    nodes[data[t - d : t], j, value] += 1
    contexts = {(c, j) for c, j, _ in nodes}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)
    own = {k: kt(nodes[(*k, 0)], nodes[(*k, 1)]) for k in contexts}
    log_w, share = {}, {}
    for d in range(depth, -1, -1):
        below = Counter()
        for (c, j), w in log_w.items():
            if len(c) == d + 1:
                below[c[1:], j] += w
        for k in contexts:
            if len(k[0]) == d:
                log_w[k] = own[k] if d == depth else np.logaddexp(own[k], below[k]) - math.log(2)
                share[k] = 1.0 if d == depth else 1 / (1 + math.exp(min(700, below[k] - own[k])))
    total, data = 0.0, b"\n" * depth + text
    visits = lambda k: nodes[(*k, 0)] + nodes[(*k, 1)]
    for t in range(depth, len(data)):
        for bit in range(8):
            j, value = (1 << bit) | (data[t] >> (8 - bit)), data[t] >> (7 - bit) & 1
            path = [(data[t - d : t], j) for d in range(depth + 1)]
            path = [k for k in path if visits(k) >= 2]
            p = 0.5
            for i, k in enumerate(reversed(path)):
                one = (nodes[(*k, 1)] + 0.5) / (visits(k) + 1)
                p = one if i == 0 else share[k] * one + (1 - share[k]) * p
            total += math.log10(p if value else 1 - p)
    return total


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_context_tree_as_by_recursion(spark, depth):
    texts = ["abra cadabra", "abracadabra abra", "a b c", "", "ABRA x", "cad dab", "zz top", "bra bra bra", "ab", "dabra"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    stream = {i: b" ".join(H.lowered(t).encode().split()) + b"\n" for i, t in enumerate(texts)}
    train = [s for i, s in stream.items() if H.held(i, 10)]
    for r in ctw.score_texts(docs, depth=depth).collect():
        assert r.score == pytest.approx(direct_ctw(train, stream[r.doc_id], depth), rel=1e-4)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxic_words_and_disguises(spark, empty):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeilmnrst"), 6)) for _ in range(80)]
    texts, labels = [], []
    for i in range(400):
        body = [*rng.choice(plain, 40)]
        if i % 8 == 0:
            body[7] = "blockhead"
        if i % 24 == 1:  # the same word in a phrase that excuses it
            body[7:9] = ["old", "blockhead", "station"]
        texts.append((i, " ".join(map(str, body))))
        labels.append((i, 1, int(i % 8 == 0)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    lexicon = toxicity.fit(docs, labelled(spark, labels))
    assert " blockhead " in lexicon.weights and " old blockhead " in lexicon.exceptions
    tests = ["you blockhead " + " ".join(plain[:30]), "you bl0ckhe4d x", "ＢＬＯＣＫＨＥＡＤ", "blосkhead", "the old blockhead station", "quiet words", "", None]
    got = toxicity.score(spark.createDataFrame(list(enumerate(tests)), "doc_id bigint, text string"), lexicon)
    assert [r.predicted for r in got.orderBy("doc_id").collect()] == [1, 1, 1, 1, 0, 0, 0, 0]
    again = toxicity.toxicity(docs, labelled(spark, labels))
    assert again.filter("score < 0 OR score > 1").count() == 0
    assert {(r.doc_id, r.held_out) for r in again.collect()} == {(i, H.held(i, 4) == 2) for i in range(400)}
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("own")), lexicon)
    assert kept.count() == 350 and kept.columns == ["doc_id", "text", "score"]
    assert toxicity.toxicity(empty, labelled(spark, [])).count() == 0


def test_quality_counts_and_rules(docs, rows, spark, empty):
    def counts(text):
        w = H.words(text)
        lines = [x for x in (text or "").split("\n") if H.words(x)]
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        twice = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        symbols = sum((text or "").count(c) for c in "#*$%&|<>")
        return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(twice)

    got = quality.quality_rules(docs, labelled(spark, []))
    want = []
    for doc_id, text, *_ in rows:
        c = counts(text)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((doc_id, *c, failed, not failed))
    assert H.result(got.drop("rule")) == sorted(want, key=repr)
    assert quality.quality_rules(empty, labelled(spark, [(1, 0, 0), (2, None, 1)])).count() == 0


def test_decision_list_finds_planted_rules():
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = pd.DataFrame({f: rng.random(3000) for f in quality.FEATURES})
    bad = (rows["symbols_per_word"] > 0.8) | (rows["upper_share"] > 0.7) & (rows["repeat_share"] < 0.3)
    rules = quality.learn(rows, bad.to_numpy())
    covered = np.logical_or.reduce([r.holds(rows) for r in rules])
    assert (covered == bad).mean() > 0.98 and len(rules) <= 6
    assert quality.learn(rows, np.zeros(3000, bool)) == [] and "symbols_per_word" in " ".join(map(str, rules))


def test_languages(spark, empty):
    rng = np.random.default_rng(5)
    parts = {"aa": ["the", "ing", "tion", "wh", "ou"], "bb": ["sch", "ich", "ung", "ä", "ei"], "cc": ["ció", "ñ", "que", "ado", "el"]}
    texts = []
    for i in range(300):
        lang = sorted(parts)[i % 3]
        texts.append((i, " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(30)), lang))
    texts += [(900, None, "aa"), (901, "", "bb"), (902, "12 ,. 3", None), (903, texts[0][1] * 50, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(docs, rounds=60, hidden=8).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in texts[:300] if H.held(i, 5) == 0]
    assert np.mean(right) > 0.95 and got[903].lang_pred == "aa"
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert language_id.language_id(empty).count() == 0
    assert language_id.language_id(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'").count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    net = language_id.Network.fresh(["a", "b"], 3, rng)
    for p in (net.tables, net.recurrences):
        p[:] = [x.astype(np.float64) for x in p]
    x, y = rng.integers(0, 5, (6, 2)), np.array([0, 1])
    mask = np.ones((6, 2), np.float32)
    mask[4:, 1] = 0
    _, grads = net.gradients(x, mask, y)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = tuple(rng.integers(0, n) for n in p.shape) if p.shape[0] != 256 else (int(x[1, 0]), 2)
        keep = p[at]
        p[at] = keep + 1e-2
        up = net.gradients(x, mask, y)[0]
        p[at] = keep - 1e-2
        down = net.gradients(x, mask, y)[0]
        p[at] = keep
        assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<div id="top-{i}"><ul><li>Home<li>News<li>Shop</ul></div><nav>menu</nav><!-- no --><div class="Ad-box">buy</div>
<div class="text"><h1>Title &amp; {i}</h1><p>First <b>bold {i}</b>&nbsp;and
 more<br>lines<p>Second {i} &lt;tag&gt;</div><aside>side</aside><form>f<p>g</form><div id="comments"><p>great!</p></div>
<div class="bottom">All rights reserved by us</div><footer>x</footer></body>"""


def test_main_text(spark):
    pages = [(i, f"http://Host.example:80/{i}", PAGE.format(i=i)) for i in range(12)]
    pages += [(90, "https://alone.example/", PAGE.format(i=90)), (91, None, None), (92, "x", ""), (93, "http://h/", "<p>a<p>b < c <i>d")]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(12):
        assert got[i].text == f"Title & {i}\n\nFirst bold {i} and more lines\n\nSecond {i} <tag>"
        assert got[i].n_chars == len(got[i].text)
    assert got[90].text.startswith("Home\n\nNews\n\nShop\n\nTitle & 90") and got[90].text.endswith("All rights reserved by us")
    assert [got[i].text for i in (91, 92, 93)] == ["", "", "a\n\nb < c d"]
    nothing = spark.createDataFrame([], "page_id bigint, url string, html string, host string, low int")
    assert html.extract(nothing).count() == 0


def test_rare_contexts_are_learned_at_any_size(spark):
    """Two training rows with a rare name, in 2 MB of others: the name's contexts count as they do alone."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, 700)) for _ in range(500)]
    name = "zyxqj wvzkp " * 2
    rare = [i for i in range(500, 600) if H.held(i, 10)][:2]
    judged = next(i for i in range(500, 600) if not H.held(i, 10))
    rows = [*enumerate(texts), *((i, name) for i in rare), (judged, name)]
    got = {r.doc_id: r for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id bigint, text string"), depth=5).collect()}
    assert len(got) == len(rows) and got[judged].held_out
    assert got[judged].bits_per_byte < 1.6
    # Small enough to be counted node by node.
    few = [(i, t[:150]) for i, t in enumerate(texts[:30])] + [(rare[0], name), (rare[1], name), (judged, name)]
    train = [H.lowered(" ".join(t.split())).encode() + b"\n" for i, t in few if H.held(i, 10)]
    for r in ctw.score_texts(spark.createDataFrame(few, "doc_id bigint, text string"), depth=5).collect():
        text = H.lowered(" ".join(dict(few)[r.doc_id].split())).encode() + b"\n"
        assert r.score == pytest.approx(direct_ctw(train, text, 5), rel=1e-5)


def test_parts_follow_the_bytes_and_split_hot_pairs(spark):
    few, many = (spark.range(n).select(F.expr("repeat('a', 1 << 20)").alias("text")) for n in (1, 1500))
    small, large = ctw._numbers_of_parts(few), ctw._numbers_of_parts(many)
    assert large[0] > 4 * small[0] and large[1] > small[1]
    # One pair of context bytes next to the byte, 64 bytes before it.
    runs = np.arange(64, dtype=np.uint64) << np.uint64(24) | np.uint64(0x206120)
    assert len(set(ctw._parts_of_runs(runs, ctw.TOP, large[0]).tolist())) > 30


def test_tags_that_only_look_like_marks():
    text = "A long text about things that matter to those who read it."
    for page in (
        f'<div style="overflow:hidden"><p>{text}</p></div>',
        f'<article title="hidden gems" data-hidden="false"><p>{text}</p></article>',
        f'<svg class="i" /><p>{text}</p>', f"<math/><p>{text}</p><svg><path/></svg>", f"<select><p>{text}</p>",
        f'<div class="with-sidebar"><main><p>{text}</p></main><div class="comments"><article>Me too, and at length. {text * 3}</article></div></div>',
        f'<div class="no-sidebar"><p>{text}</p><div class="related">Others</div></div>',
        f'<div class="elementor-widget"><p>{text}</p></div><div class="ad">Buy</div>',
    ):
        assert html.main_text(page) == text
    for page in (f"<div hidden><p>{text}</p></div>", f'<p aria-hidden="true">{text}</p>', f"<script>{text}", f"<svg><text>{text}</text></svg>"):
        assert html.main_text(page) == ""
    assert html.main_text(f'<article><p>{text}</p><div class="ad">Buy</div></article>') == text


def test_what_context_trees_write_is_squeezed(spark):
    """Tables written on the way stay under twice the texts."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmno"), 4)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 400))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    assert ctw.score_texts(docs).count() == len(rows)
    on_disk = {path: sum(f.stat().st_size for f in path.rglob("*.parquet")) for path in set(folder.iterdir()) - before}
    by_slice = sum(size for path, size in on_disk.items() if "slice" in spark.read.parquet(str(path)).columns)
    assert 0 < by_slice < 1.8 * sum(len(text) for _, text in rows)


def test_slices_in_chunks(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["ab", "abc", "ba", "cab", "zz"], n)) for n in rng.integers(0, 60, 50)] + ["x" * 900, ""]
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts))), pa.array(texts), pa.array([i % 3 > 0 for i in range(len(texts))])], names=["doc_id", "text", "taught"]
    )
    whole = ctw._slice(rows, 5, 7, 3, 0)
    monkeypatch.setattr(ctw, "CHUNK", 100)
    assert ctw._slice(rows, 5, 7, 3, 0).equals(whole)
    codes = np.sort(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    assert (ctw.unpacked(ctw.packed(codes)) == codes).all() and len(ctw.unpacked(ctw.packed(codes[:0]))) == 0
