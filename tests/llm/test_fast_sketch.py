"""Sketches, and near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest
from test_simhash import edited, plain_components

from threatloom.llm import fast_sketch as fs


def shingles(text, size=3):
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_groups(rows, percent=85):
    sets = [(k, shingles(t)) for k, t in rows]
    linked = lambda i, j: bool(sets[i][1]) and 100 * len(sets[i][1] & sets[j][1]) >= percent * len(sets[i][1] | sets[j][1]) and bool(sets[j][1])
    root, low = plain_components(list(range(len(sets))), linked), {}
    for i, (k, s) in enumerate(sets):
        if s and k is not None:
            low[root[i]] = min(low.get(root[i], k), k)
    out = [(k, len(s), (low.get(root[i]) if s else k)) for i, (k, s) in enumerate(sets)]
    return sorted((*r, r[0] == r[2]) for r in out) if all(r[0] is not None for r in out) else sorted(((*r, r[0] == r[2]) for r in out), key=repr)


def got_groups(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_given_table(documents, texts):
    assert got_groups(fs.near_duplicates(documents)) == sorted(plain_groups(list(texts.items())), key=repr)


def test_edges(edge_docs, no_docs):
    got = got_groups(fs.near_duplicates(edge_docs))
    assert got == sorted(plain_groups([(r["doc_id"], r["text"]) for r in edge_docs.collect()]), key=repr)
    assert fs.near_duplicates(no_docs).collect() == []


def test_edits_near_the_threshold(spark):
    """Added, cut and replaced passages and words, with similarities on both sides of 0.85."""
    draw = random.Random(17)
    word = lambda: f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{draw.randrange(3000)}"
    rows = []
    for n in range(200):
        text = [word() for _ in range(draw.randint(3, 300))]
        size = int(len(text) * draw.uniform(0.0, 0.2))
        more = [word() for _ in range(size)]
        cut = draw.randrange(len(text) - size + 1)
        copy = [text + more, more + text, text[size:], text[: len(text) - size], text[:cut] + more + text[cut + size :], edited(" ".join(text), draw, max(30, 1500 // (size + 1))).split()][n % 6]
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    got = got_groups(fs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    want = sorted(plain_groups(rows), key=repr)
    assert got == want
    linked = sum(not r[3] for r in want)
    assert 60 < linked < 180


def templated(draw, own, count, words=200):
    """Texts that share a template and differ in one passage of ``own`` words."""
    base = [f"w{i}" for i in range(words)]
    return [" ".join(base + [f"x{n}y{i}z{draw.randrange(10**6)}" for i in range(own)]) for n in range(count)]


@pytest.mark.parametrize("block_nodes", [512, 3])
def test_groups_that_the_smallest_nodes_do_not_join(spark, monkeypatch, block_nodes):
    """Chains and dense groups that lie near each other: the groups are those of all pairs."""
    monkeypatch.setattr(fs, "BLOCK_NODES", block_nodes)
    draw = random.Random(3)
    rows, key = [], 0
    for family in range(3):
        text = [f"f{family}w{i}" for i in range(150)]
        for _ in range(50):
            own = list(text)
            for at in draw.sample(range(0, 150, 5), draw.randint(0, 5)):
                own[at] = f"x{key}y{at}"
            rows.append((key, " ".join(own)))
            key += 1
            if draw.random() < 0.15:  # later texts derive from this one
                text = own
    got = got_groups(fs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == sorted(plain_groups(rows), key=repr)
    assert 3 < len({r[2] for r in got}) < 100


def test_templated_texts_are_not_compared_one_by_one(spark):
    """Texts at a similarity of 0.74 share buckets, but the prefix join keeps no pair of them."""
    draw = random.Random(2)
    texts = templated(draw, 35, 300)
    sets = [sorted(shingles(t)) for t in texts]
    number = {s: i for i, s in enumerate({x for s in sets for x in s})}
    points = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "node long, n long, component long")
    full = spark.createDataFrame([(i, [number[x] for x in s]) for i, s in enumerate(sets)], "node long, shingles array<long>")
    assert fs.prefix_pairs(points, full, 85).count() == 0
    assert fs.prefix_pairs(points, full, 70).count() == 300 * 299 // 2
    rows = list(enumerate(texts))
    assert got_groups(fs.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(plain_groups(rows), key=repr)


def test_sketches_fill_every_coordinate_and_estimate_similarity():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 0, 2, 5, 40, 3000])
    table = fs.sketches(rng.integers(0, 1 << 63, sizes.sum()).astype(np.uint64), sizes, 64)
    assert (table[sizes > 0] != fs.EMPTY).all() and (table[1] == fs.EMPTY).all()
    for n in (8, 100, 2000):
        errors = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            a, b = pool[: n + n // 2], pool[n // 2 :]
            both = fs.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), 256)
            errors.append((both[0] == both[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.5 * (0.25 / 256) ** 0.5


def test_sketches_of_a_batch_are_those_of_single_sets():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 3, 700, 20)]
    whole = fs.sketches(np.concatenate(sets), np.array([len(s) for s in sets]), 120)
    for row, s in zip(whole, sets):
        assert (fs.sketches(s[::-1], np.array([len(s)]), 120)[0] == row).all()


def test_band_count_keeps_pairs_at_the_threshold():
    bands = fs.band_count(85)
    assert (1 - 0.85**fs.BAND_ROWS) ** bands <= fs.MISSED
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        a, b = pool[:92], pool[8:]  # 84 of 100 shared
        keys = fs.band_keys(fs.sketches(np.concatenate([a, b]), np.array([92, 92]), bands * fs.BAND_ROWS))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0
