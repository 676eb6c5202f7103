import hashlib
from collections import defaultdict

import corpus_pipeline
import text_helpers as H
from test_copies import links, removed

from atticsweep.llm import toxicity
from atticsweep.session import written


def test_stages_against_brute_force(spark, rows, tmp_path_factory):
    """Each stage on what the one before kept; the last one's pieces hold all that is left."""
    sf_dir = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, f"{t} blockhead" if i is not None and i % 10 == 3 and t else t, *r) for i, t, *r in rows if i != 300]
    H.frame(spark, rows).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(
        [(r[0], 1, int("blockhead" in (r[1] or ""))) for r in rows if r[0] is not None], "doc_id bigint, quality int, toxic int"
    ).write.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    def step(number, docs):
        out = corpus_pipeline.STAGES[number][1](spark, docs, sf_dir)
        path = str(tmp_path_factory.mktemp("stage") / "t")
        out.write.parquet(path)
        return spark.read.parquet(path)

    def of(docs):
        assert docs.columns == columns
        return [tuple(r)[:5] for r in docs.collect()]

    lexicon = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    flagged = {r.doc_id for r in toxicity.score(docs, lexicon).filter("predicted = 1").collect()}
    assert flagged & {r[0] for r in rows if "blockhead" in (r[1] or "")}
    clean = step(0, docs)
    assert {r[0] for r in of(clean)} == {r[0] for r in rows} - flagged

    groups = defaultdict(list)
    for r in of(clean):
        groups["".join(H.SPACES.split(r[1] or ""))].append((-len(r[1] or ""), r[0] is None, r[0]))
    distinct = step(1, clean)
    assert {r[0] for r in of(distinct)} == {min(g)[2] for g in groups.values()}

    apart = step(2, distinct)
    assert {r[0] for r in of(apart)} == {i for i, _, c in links(of(distinct)) if i == c}

    kept = step(3, apart)
    want = {r[0]: r for r in removed(of(apart))}
    assert len(of(kept)) == len(want) and any(r[2] for r in want.values())
    for doc_id, text, *_, n_chars in of(kept):
        assert n_chars == (len(text) if text is not None else None) or text is None
        if want[doc_id][2]:
            assert hashlib.sha256(text.encode()).hexdigest() == want[doc_id][3]

    packed = step(4, kept)
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r.doc_id] += r.length
        assert r.offset + r.length <= 2048
    assert {(r.doc_id, r.doc_tokens) for r in packed.collect()} == set(tokens.items())
    assert set(tokens) == {r[0] for r in of(kept)}
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_near_copies_from_four_fifths_of_five_word_shingles_on(spark):
    """One copy with a fifth more text, one with a changed word per 47: both are near copies for the stage."""
    words = [f"w{i}" for i in range(470)]
    more = words[:100] + [f"v{i}" for i in range(22)]
    changed = [f"x{i}" if i % 47 == 20 else w for i, w in enumerate(words)]
    texts = [words, words[:100], more, changed, [f"u{i}" for i in range(90)]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)]
    kept = corpus_pipeline.remove_near_copies(spark, H.frame(spark, rows), "")
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in links(rows, 5, 80) if i == c} == {0, 1, 4}


def test_repeated_rows_and_null_ids(spark):
    """Of equal rows one stays, with its text; a dropped row takes no other row of its id along."""
    long = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"]
    rows = [
        (300, long[0]), (300, long[0]), (1, long[1]), (None, long[1]), (None, long[2]), (None, long[3]), (None, long[3]),
        (5, long[4]), (7, long[4] + " more"), (7, long[5]), (None, long[5] + " more"), (None, None), (None, None),
    ]
    docs = H.frame(spark, [(i, t, "en", "s", 0) for i, t in rows])
    exact = written(corpus_pipeline.remove_exact_copies(spark, docs, ""))
    assert exact.columns == docs.columns
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    want = [r for i, r in enumerate(rows) if i not in (1, 3, 6, 12)]
    assert pairs(exact) == sorted(want, key=repr)
    want = sorted([(300, long[0]), (1, long[1]), (None, long[2]), (None, long[3]), (5, long[4]), (7, long[5]), (None, None)], key=repr)
    assert pairs(corpus_pipeline.remove_near_copies(spark, docs, "")) == sorted([*want, (None, None)], key=repr)
    near = written(corpus_pipeline.remove_near_copies(spark, exact, ""))
    assert near.columns == docs.columns and pairs(near) == want
    assert pairs(corpus_pipeline.remove_repeated_passages(spark, near, "")) == want
