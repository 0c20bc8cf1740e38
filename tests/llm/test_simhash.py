import re

import numpy as np
import pytest
import xxhash

from elevspark.llm import simhash
from elevspark.llm.components import components
from elevspark.llm.simhash import close_pairs, forest, linked_nodes, pigeonhole, simhash_groups


def brute_fp(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def near(rng, n, centres, flips):
    base = rng.integers(0, 2**63, centres, dtype=np.uint64) * np.uint64(2)
    out = base[rng.integers(0, centres, n)]
    for _ in range(flips):
        out = out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64))
    return np.unique(out)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7, 9])
def test_bit_sliced_pairs_match_brute_force(radius):
    rng = np.random.default_rng(radius)
    fps = np.concatenate([near(rng, 150, 6, 5), near(rng, 90, 50, 4)])
    first = np.array([0, 1, 2, 70, 71, 140, len(fps) - 3])
    run = np.searchsorted(first, np.arange(len(fps)), "right")
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if run[i] == run[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}
    got = [(int(a), int(b)) for i, j in close_pairs(fps[:, None], first, radius, most=100) for a, b in zip(i, j, strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_wide_fingerprints_and_forest():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**63, (130, 4), dtype=np.uint64)
    fps[1:60] = fps[0]
    fps[1:60, 2] ^= rng.integers(0, 2**20, 59, dtype=np.uint64)
    dist = lambda i, j: sum(int(x).bit_count() for x in fps[i] ^ fps[j])
    want = {(i, j) for i in range(130) for j in range(i + 1, 130) if dist(i, j) <= 12}
    pairs = list(close_pairs(fps, np.array([0]), 12))
    assert {(int(a), int(b)) for i, j in pairs for a, b in zip(i, j, strict=True)} == want
    root = forest(130, iter(pairs))
    assert all(root[i] == root[j] for i, j in want) and all(root[root] == root)


def test_hot_buckets_are_tiled_without_losing_links(spark):
    rng = np.random.default_rng(3)
    fps = near(rng, 500, 4, 4)
    nodes = spark.createDataFrame([(i, bytearray(int(f).to_bytes(8, "big"))) for i, f in enumerate(fps)], "nid long, fp binary")
    links = linked_nodes(nodes, pigeonhole(64, 4, 6), 4, 1, part=32)
    root = {r.node: r.root for r in components(links).collect()}
    assert [root.get(i, i) for i in range(len(fps))] == brute_groups([int(f) for f in fps], 4)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 140)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "One two", "one TWO", "One two three four", "ÀB c d e f", "àb c d e f", " ".join(words), " ".join([*words[:1500], "x", *words[1501:]]), " ".join(words[::-1]), "a " * 900, "a a a a", "A\x0ba\x1ca a"]
    data = [(50 - i if i != 5 else None, t, 1) for i, t in enumerate(texts)] + [(7, "One two", 1), (7, "One two", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp int").drop("fp")
    rows = simhash_groups(df, ["doc_id"]).collect()
    fps = [brute_fp(t) for _, t, _ in data]
    roots = brute_groups(fps, 4)
    low = {}
    for (d, _, _), r in zip(data, roots, strict=True):
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    want = sorted(((d, f"{f:016x}", low[r]) for (d, _, _), f, r in zip(data, fps, roots, strict=True)), key=str)
    assert sorted(((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in rows), key=str) == want
    assert simhash_groups(df.where("false"), ["doc_id"]).count() == 0
    assert simhash.SHINGLE == 4


def test_texts_without_words_lie_far_from_short_ones_in_near_dedup():
    from array import array

    rng = np.random.default_rng(1)
    blank = simhash.fingerprints([array("Q", simhash.BLANK)], 4)
    short = simhash.fingerprints([array("Q", [int(x) for x in rng.integers(0, 2**63, 2, dtype=np.uint64)]) for _ in range(2000)], 4)
    gaps = np.unpackbits((short ^ blank).view(np.uint8), axis=1).sum(1)
    assert gaps.min() > simhash.NEAR["radius"]
