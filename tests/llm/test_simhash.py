"""SimHash links and groups against brute force."""

from __future__ import annotations

import numpy as np
import xxhash

from civicmill.llm.similar import shingle_hashes, similar_groups
from civicmill.llm.simhash import band_masks, fingerprint, grow, near_duplicates, route

SCHEMA = "doc_id long, text string, lang string, fp string, node int, root string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, "y") for i, t in texts], SCHEMA)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed=3, n=160):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    out = []
    for k in range(n):
        base = [word() for _ in range(int(rng.integers(1, 120)))]
        out.append((3 * k, " ".join(base)))
        for c in range(k % 3):
            changed = list(base)
            for _ in range(c):
                changed[int(rng.integers(len(changed)))] = word()
            out.append((3 * k + c + 1, " ".join(changed)))
    return [*out, (9001, None), (9002, ""), (9003, " \n\t"), (9004, "One two"), (9004, "One two"), (9005, "ONE  two"), (9006, "mot " * 30_000)]


def test_fingerprint_is_the_plain_one():
    for _, t in texts():
        if t is None or len(t) < 10_000:
            assert fingerprint(t) == plain_fingerprint(t)


def test_components_are_those_of_all_pairs(spark):
    rows = texts()
    got = near_duplicates(frame(spark, rows)).collect()
    prints = [(i, fingerprint(t)) for i, t in rows]
    linked = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 3]
    want = roots({i for i, _ in rows}, linked)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_every_linked_pair_meets_in_a_shard():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    points = np.unique(np.concatenate([base, near]))
    met = {int(p): set() for p in points}
    for t, mask in enumerate(band_masks(2)):
        tree = grow(rng.permutation(points), 1, 200, mask)
        for node, at in route(tree, points, np.arange(len(points)), 1, mask):
            for p in points[at]:
                met[int(p)].add((t, node.shard))
    assert all(met[int(a)] & met[int(b)] for a, b in zip(base, near))


def test_groups_of_similar_texts(spark):
    rows = [r for r in texts(5, 80) if r[0] != 9004]
    got = {r["doc_id"]: r["group"] for r in similar_groups(frame(spark, rows)).collect()}
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    linked = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.9 * len(x | y)]
    loose = roots(set(sets), [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and len(x & y) >= 0.8 * len(x | y)])
    assert all(got[a] == got[b] for a, b in linked)
    assert all(loose[i] == loose[g] for i, g in got.items())


def test_empty_and_null_ids(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    got = near_duplicates(frame(spark, [(None, "alone here now"), (5, "alone here now"), (None, "another text entirely, quite")])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5)]


def jaccard(x, y):
    return len(x & y) / len(x | y)


def grouped_by_brute_force(rows):
    sets = {i: set(shingle_hashes(t, 5).tolist()) for i, t in rows}
    return roots(set(sets), [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and jaccard(x, y) >= 0.8])


def test_groups_are_exact_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows = []
    for k, n in enumerate([*range(10, 31), *range(60, 400, 20)]):
        base = [word() for _ in range(n)]
        for c, share in enumerate((0, 0.05, 0.1, 0.15, 0.2, 0.25)):
            rows.append((100 * k + c, " ".join([*base, *(word() for _ in range(int(share * n)))])))
        rows += [(100 * k + 10 + c, " ".join(base[: int((1 - share) * n)])) for c, share in enumerate((0.1, 0.15, 0.2, 0.3))]
    got = {r["doc_id"]: r["group"] for r in similar_groups(frame(spark, rows)).collect()}
    assert got == grouped_by_brute_force(rows)


def test_a_large_group_near_the_threshold_stays_whole(spark):
    rng = np.random.default_rng(11)
    base, rows = [f"w{k}" for k in range(120)], []
    for i in range(500):  # the words' set hardly moves, so all copies are within a few bits; many links are below 0.8
        copy = list(base)
        for _ in range(int(rng.integers(1, 5))):
            a = int(rng.integers(110))
            copy[a], copy[a + 7] = copy[a + 7], copy[a]
        rows.append((i, " ".join(copy)))
    got = {r["doc_id"]: r["group"] for r in similar_groups(frame(spark, rows)).collect()}
    assert got == grouped_by_brute_force(rows)
