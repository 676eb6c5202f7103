import hashlib
import random
import time
from collections import Counter, defaultdict
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import text_helpers as H
from pyspark.sql import DataFrame

from atticsweep.llm import components as component_links
from atticsweep.llm import exact_dedup, jaccard_join, substring_dedup
from atticsweep.llm.common import shuffles_removed
from atticsweep.llm.components import components
from atticsweep.session import Workspace, written


def test_exact_groups(docs, rows, empty):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups["".join(H.SPACES.split(text or ""))].append((-len(text or ""), doc_id))
    want = []
    for bare, members in groups.items():
        most = min(m[0] for m in members)
        ids = [i for m, i in members if m == most and i is not None]
        keep = min(ids) if ids else None
        want += [(i, keep, len(members), i == keep, hashlib.sha256(bare.encode()).hexdigest()) for _, i in members]
    got = H.result(exact_dedup.exact_groups(docs, first_width=4, growth=3))
    assert got == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_copies_go_with_all_columns_kept(docs, rows):
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    kept = {(r[0], r[1]) for r in H.result(exact_dedup.exact_groups(docs)) if r[3]}
    assert {r.doc_id for r in left.select("doc_id").collect()} == {k[0] for k in kept}


def test_keys_of_near_copies_are_not_stored(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(32):x}" for _ in range(500))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with Workspace(spark) as work:
        got, _ = jaccard_join.near_copies(docs)
    assert got.count() == len(rows)
    stored = sum(p.stat().st_size for p in Path(work.folder).rglob("*.parquet"))
    work.remove()
    assert stored < 0.2 * sum(len(text) for _, text in rows)  # sketches and small tables; keys alone are 0.35


def test_texts_come_to_repeats_in_small_batches(spark, monkeypatch):
    scan_of = substring_dedup._scan

    def scan_small(k, m):
        scan = scan_of(k, m)

        def check(batches):
            def small():
                for rows in batches:
                    assert rows.nbytes < 9 << 20
                    yield rows

            return scan(small())

        return check

    monkeypatch.setattr(substring_dedup, "_scan", scan_small)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(0, 320, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 40), i -> repeat(cast(id * i AS string), 250)), ' ') AS text")
    assert substring_dedup.removal_digests(docs).count() == 320
    assert spark.conf.get(name) == before


def links(rows, k=4, percent=85):
    sets = []
    for doc_id, text, *_ in rows:
        w = H.lowered(text).encode().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else zip(*(w[i:] for i in range(k)), strict=False)))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                top[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc_id, *_) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {t: min((x for x in found if x is not None), default=None) for t, found in ids.items()}
    return sorted([(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))], key=repr)


@pytest.mark.parametrize("group,levels", [(2000, 4), (1, 2)])
def test_near_copies(docs, rows, group, levels):
    """``group=1`` sends every mixed key through the finer sketches."""
    assert H.result(jaccard_join.near_copy_components(docs, group=group, levels=levels)) == links(rows)


def test_near_copies_of_nothing_and_one_of_each(docs, rows, empty):
    assert jaccard_join.near_copy_components(empty).count() == 0
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, _, c in links(rows) if i == c}


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    bands = jaccard_join.Bands(85)
    for size in (6, 7, 9, 20, 60, 150, 700, 3000):
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            cut = rng.integers(0, size // 7 + 1)
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 63, rng.integers(0, 3)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            assert jaccard_join.distance(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(a) + len(b) - 2 * both
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) != both:
                assert np.intersect1d(jaccard_join.join_keys(a, bands, 0), jaccard_join.join_keys(b, bands, 0)).size


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (200, 199), (200, 199)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def removed(rows, k=35):
    split = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in split for i in range(len(w) - k + 1))
    out = []
    for doc_id, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [1000, 2])
def test_repeated_passages(docs, rows, hot):
    want = removed(rows)
    assert sum(r[2] for r in want) > 500
    assert H.result(substring_dedup.removal_digests(docs, hot=hot)) == want


def test_a_passage_in_all_texts(spark):
    """One passage with other words around it in each text, copies of whole texts, and hot minimisers at every level."""
    import random

    rng = random.Random(6)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(120):
        own = [f"w{rng.randrange(5000)}" for _ in range(40)]
        rows.append((i, " ".join([*own[:20], *passage, *own[20:]]), "en", "s", 0))
    rows += [(1000 + i, rows[i % 3][1], "en", "s", 0) for i in range(40)]
    for hot in (5, 50):
        assert H.result(substring_dedup.removal_digests(H.frame(spark, rows), hot=hot)) == removed(rows)


def test_repeated_rows_grow_in_proportion(spark):
    """Rows of one id and text: as many starts for the text, however many rows there are."""
    text = " ".join(f"w{i}" for i in range(100))
    starts = []
    for n in (20, 200):
        rows = [(None, text, "en", "s", 0)] * n
        assert H.result(substring_dedup.removal_digests(H.frame(spark, rows))) == removed(rows)
        _, marked = substring_dedup._marked(H.frame(spark, rows), 35, 6, 1000)
        starts.append(marked.selectExpr("sum(size(starts))").first()[0])
    assert starts[1] == 10 * starts[0]


def test_texts_without_repeats(docs, rows, empty):
    left = substring_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    want = {r[0]: r for r in removed(rows)}
    for r in left.collect():
        if want[r.doc_id][2]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]
    assert substring_dedup.removal_digests(empty).count() == 0


def test_near_copies_with_a_common_opening(spark):
    """Nearly all keys are crowded, and the refined ones that a pair shares are often held by the two alone."""
    opening = [f"w{i}" for i in range(8)]
    rows = []
    for i in range(300):
        own = [*opening, *(f"x{i}y{j}" for j in range(3))]
        rows += [(2 * i, " ".join(own), "en", "s", 0), (2 * i + 1, " ".join([*own, "more"]), "en", "s", 0)]
    got = H.result(jaccard_join.near_copy_components(H.frame(spark, rows), group=3))
    assert got == links(rows) and {c for *_, c in got} == set(range(0, 600, 2))


def test_closest_pairs_of_components():
    """Of a key's classes that are all close, each component gives its closest pair alone."""
    n = 60
    bits = np.zeros((n, 64), np.uint8)
    bits[:, : n // 8] = np.random.default_rng(2).integers(0, 2, (n, n // 8))
    columns = {"key": [5] * n, "low": [0] * n, "high": [0] * n, "class": range(n), "comp": [i // 3 for i in range(n)], "n": [100] * n, "block": [0] * n}
    arrays = [pa.array(c, pa.int64()) for c in columns.values()]
    arrays += [pa.array([b.tobytes() for b in np.packbits(bits, axis=1)]), pa.array([None] * n, pa.list_(pa.int64()))]
    rows = pa.RecordBatch.from_arrays(arrays, names=[*columns, "sketch", "keys"])
    every = [p for b in jaccard_join._near_in_keys(85, False)(iter([rows])) for p in zip(*b.to_pydict().values(), strict=True)]
    few = [p for b in jaccard_join._near_in_keys(85, True)(iter([rows])) for p in zip(*b.to_pydict().values(), strict=True)]
    assert len(every) == n * (n - 3) // 2 and len(few) <= n // 3 and set(few) <= set(every)
    for c in range(n // 3):
        own = [int((bits[a] != bits[b]).sum()) for a, b in every if c in (a // 3, b // 3)]
        assert min(own) in [int((bits[a] != bits[b]).sum()) for a, b in few if c in (a // 3, b // 3)]


def test_group_of_near_copies_by_rounds(spark):
    """Copies around the threshold: the same components whether the closest pairs come first or all pairs at once."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(80, 2, replace=False):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(t.split()[j : j + 4]) for j in range(77)} for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and comp[i] != comp[j]:
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    for rounds in (0, 3):
        got = {r.doc_id: r.component_id for r in jaccard_join.near_copy_components(docs, rounds=rounds).collect()}
        assert got == dict(enumerate(comp))


def test_packed_keys():
    rng = np.random.default_rng(3)
    pairs = np.stack([np.sort(rng.integers(0, 1 << 48, 4000) // 200), rng.integers(-(1 << 62), 1 << 62, 4000)], axis=1)
    data = jaccard_join.packed(pairs)
    assert (jaccard_join.unpacked(data) == pairs).all() and len(data) < 13 * len(pairs)
    assert len(jaccard_join.unpacked(jaccard_join.packed(pairs[:0]))) == 0


@pytest.mark.parametrize("few_bytes", [0, 1 << 20])
def test_components_joined_step_by_step(spark, monkeypatch, few_bytes):
    monkeypatch.setattr(component_links, "FEW_BYTES", few_bytes)
    rng = random.Random(5)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    frames = [spark.createDataFrame([p for p in part if p[0] != p[1]], "a bigint, b bigint") for part in (links[:20], links[20:30], links[30:])]
    comps = components(frames[0])
    for more in frames[1:]:
        comps = component_links.joined(comps, more)
    whole = {r["node"]: r["comp"] for r in components(reduce(DataFrame.unionByName, frames)).collect()}
    rows = comps.collect()
    assert len(rows) == len(whole) and {r["node"]: r["comp"] for r in rows} == whole


def family(n, words, most, seed):
    """Copies of one text with up to ``most`` words changed, some of them close and some apart from all others."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        own = [f"w{j}" for j in range(words)]
        for at in rng.choice(words, rng.integers(1, most + 1), replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(own), "en", "s", 0))
    return rows


@pytest.mark.parametrize("refined", [jaccard_join.REFINED, 0])
def test_a_family_of_near_copies_is_not_refined(spark, monkeypatch, refined):
    """Whatever its size, its classes are compared once, in blocks; refined keys give the same components."""
    made, refine_of = [], jaccard_join._refined
    monkeypatch.setattr(jaccard_join, "_refined", lambda *a: made.append(a) or refine_of(*a))
    rows = family(160, 70, 14, 7)
    rows += [(1000 + i, " ".join([t, *(f"y{j}" for j in range(60))]), *rest) for i, t, *rest in family(40, 70, 12, 8)]
    docs = H.frame(spark, rows)
    got = H.result(jaccard_join.near_copy_components(docs, group=12, refined=refined, levels=2))
    assert got == links(rows)
    assert len({c for *_, c in got}) > 20 and bool(made) == (refined == 0)


def test_pairs_in_blocks_of_any_sizes():
    """Sizes, and so lengths of sketches, differ; one component has most of the classes."""
    rng = np.random.default_rng(9)
    sets = []
    for i in range(130):
        base = np.arange(100 + 6 * (i % 13), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        keep = np.delete(base, rng.choice(len(base), rng.integers(1, 25), replace=False))
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 20)).astype(np.uint64)])))
    comp, block = [0 if i < 75 else i for i in range(130)], [i % 2 for i in range(130)]
    sketches = [jaccard_join.sketch(s) for s in sets]
    assert len(set(map(len, sketches))) > 1

    def pairs(low, high, closest):
        held = [i for i in range(130) if block[i] in (low, high)]
        columns = {"key": [5] * 130, "low": [low] * 130, "high": [high] * 130, "class": range(130), "comp": comp, "n": list(map(len, sets)), "block": block}
        arrays = [pa.array([list(c)[i] for i in held], pa.int64()) for c in columns.values()]
        arrays += [pa.array([sketches[i] for i in held]), pa.array([None] * len(held), pa.list_(pa.int64()))]
        rows = pa.RecordBatch.from_arrays(arrays, names=[*columns, "sketch", "keys"])
        return [p for b in jaccard_join._near_in_keys(80, closest)(iter([rows])) for p in zip(*b.to_pydict().values(), strict=True)]

    def near(a, b):
        m, n = sorted((len(sets[a]), len(sets[b])))
        return 180 * jaccard_join.distance(sketches[a], sketches[b]) <= 20 * (m + n) and 100 * m >= 80 * n

    want = [(a, b) for a in range(130) for b in range(a + 1, 130) if comp[a] != comp[b] and near(a, b)]
    got = [p for low, high in ((0, 0), (0, 1), (1, 1)) for p in pairs(low, high, False)]
    assert len(want) > 300 and sorted(got) == want
    for low, high in ((0, 0), (0, 1), (1, 1)):
        few = pairs(low, high, True)
        own = [p for p in want if {block[p[0]], block[p[1]]} == {low, high}]
        parties = {comp[c] for p in own for c in p}
        assert set(few) <= set(own) and len(few) <= len(parties) and parties - {0} <= {comp[c] for p in few for c in p}


def test_shuffles_go_with_their_job(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before, own = shuffles(), spark.conf.get(name)
    with shuffles_removed(spark):
        assert written(spark.range(1000).repartition(5, "id")).count() == 1000
    end = time.time() + 10
    while (left := {f for f in shuffles() - before if f.startswith("shuffle_")}) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(name) == own
    assert written(spark.range(1000).repartition(5, "id")).count() == 1000  # without it they stay
    assert {f for f in shuffles() - before if f.startswith("shuffle_")}
