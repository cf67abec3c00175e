"""Fingerprints, links and groups against all pairs."""

import random

import pytest
import xxhash

from threatloom.llm import simhash
from threatloom.llm.components import components


def plain_fingerprint(text, size=4):
    words = (text or "").encode().lower().split()  # bytes.lower changes A-Z only
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def expected_groups(rows):
    fps = [(key, plain_fingerprint(text)) for key, text in rows]
    group = plain_components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for key, f in fps:
        if key is not None:
            low[group[f]] = min(low.get(group[f], key), key)
    return sorted(((key, f"{f:016x}", low.get(group[f])) for key, f in fps), key=str)


def test_groups_equal_all_pairs(documents, texts):
    got = sorted(map(tuple, simhash.near_groups(documents).collect()), key=str)
    assert got == expected_groups(list(texts.items()))


def test_group_edges(edge_docs, no_docs):
    got = sorted(map(tuple, simhash.near_groups(edge_docs).collect()), key=str)
    assert got == expected_groups([(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert simhash.near_groups(no_docs).collect() == []


@pytest.mark.parametrize("shard_rows", [20_000, 16])
def test_links_have_the_components_of_all_pairs(spark, shard_rows):
    """Chains and dense clusters of fingerprints, with shards whole and cut into many trees."""
    draw = random.Random(5)
    fps = set()
    for _ in range(6):
        base = draw.getrandbits(64)
        for _ in range(60):
            fp = base
            for _ in range(draw.randint(0, 5)):
                fp ^= 1 << draw.randrange(64)
            fps.add(fp)
            if draw.random() < 0.2:
                base = fp
    fps |= {draw.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = sorted(map(signed, fps))
    points = spark.createDataFrame([(f, f) for f in nodes], "node long, fp long")
    found = {r["node"]: r["component"] for r in components(simhash.link_fingerprints(points, 4, shard_rows=shard_rows)).collect()}
    mask = (1 << 64) - 1
    want = plain_components(nodes, lambda a, b: ((a ^ b) & mask).bit_count() <= 4)
    assert {n: found.get(n, n) for n in nodes} == want


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(399) if i % 100 != 99] + [(7, 3), (5, 5), (900, 901), (900, 901)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(400)} | {900: 900, 901: 900}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def similarity(a, b, size=5):
    cut = lambda t: {tuple(w[i : i + size]) for w in [t.lower().split()] for i in range(max(1, len(w) - size + 1))}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b)


def edited(text, draw, every):
    words = text.split()
    for i in range(0, len(words), every):
        words[min(len(words) - 1, i + draw.randrange(every))] = f"new{draw.randrange(10**6)}"
    return " ".join(words)


def test_keep_one_of_exact_and_near_copies(spark):
    draw = random.Random(9)
    words = [f"{a}{b}{c}" for a in "th er on an re he in ed nd ha".split() for b in "at en es of or nt ti to it st".split() for c in "abcdef"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(150, 400))) for _ in range(40)]
    rows, key = [], 0
    owner = {}
    for n, text in enumerate(base):
        for copy in [text] * draw.randint(1, 3) + [edited(text, draw, 150) for _ in range(n % 4)]:
            rows.append((key, copy, "x", "s", len(copy)))
            owner[key] = n
            key += 1
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = sorted(r["doc_id"] for r in kept.collect())
    assert left == sorted(min(k for k in owner if owner[k] == n) for n in range(len(base)))


def test_keep_one_against_all_pairs(documents, texts):
    """No two kept texts are similar; a text that goes has a similar one in its group."""
    left = {r["doc_id"] for r in simhash.keep_one(documents).collect()}
    keys = sorted(texts)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if similarity(texts[a], texts[b]) >= 0.8]
    both = [p for p in pairs if p[0] in left and p[1] in left]
    assert len(both) <= 0.02 * len(pairs)
    gone = set(keys) - left
    assert all(any(similarity(texts[g], texts[k]) >= 0.6 for k in keys if k != g) for g in gone)


def test_keep_one_edges(edge_docs, no_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(got) == len(set(got))
    # wordless texts are one group; repeated rows give one row
    assert sorted(k for k, _ in got if k is not None) == [0, 3, 4, 5, 6, 7, 9, 10, 11]
    assert (None, "a row without an id and a few more words to make it long enough") in got
    assert simhash.keep_one(no_docs).collect() == []


def test_pairs_of_every_kind_of_edit_are_linked(spark):
    """Copies with an added, cut or replaced passage, or replaced words, are linked from a similarity of 0.8 on."""
    draw = random.Random(31)
    word = lambda: f"{draw.choice('bcdfglmnprst')}{draw.choice('aeiou')}{draw.randrange(3000)}"
    rows = []
    for n in range(240):
        text = [word() for _ in range(draw.randint(60, 500))]
        size = int(len(text) * draw.uniform(0.02, 0.3))
        more = [word() for _ in range(size)]
        cut = draw.randrange(len(text) - size)
        copy = [text + more, more + text, text[size:], text[:-size], text[:cut] + more + text[cut + size :], edited(" ".join(text), draw, max(30, 2000 // size)).split()][n % 6]
        rows += [(2 * n, " ".join(text)), (2 * n + 1, " ".join(copy))]
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    part = {r["id"]: r["component"] for r in found.collect()}
    pairs = [similarity(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert sum(s >= 0.8 for s in pairs) > 80 and sum(s < 0.8 for s in pairs) > 20
    assert [part[2 * n] == part[2 * n + 1] for n in range(len(pairs))] == [s >= 0.8 for s in pairs]


def test_pairs_left_for_the_second_round(spark):
    """Many texts that are uncertain by sketch, a chain and a dense group: the groups are those of all pairs."""
    draw = random.Random(3)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(60):
        own = list(text)
        for at in draw.sample(range(0, 120, 8), draw.randint(1, 4)):
            own[at] = f"x{n}y{at}"
        rows.append((n, " ".join(own)))
    sets = dict(rows)
    want = plain_components(sorted(sets), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    found = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string"), first_pairs=1, shard_rows=7)
    got, low = {r["id"]: r["component"] for r in found.collect()}, {}
    for k in sorted(got):
        low.setdefault(got[k], k)
    assert {k: low[c] for k, c in got.items()} == want
