"""SimHash and repeated substrings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tesserae.llm import common, simhash, suffix_dedup

from .conftest import rows_of


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            found += [word] if word else []
            word = ""
        else:
            word += c
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[root(k)] = min(least.get(root(k), d), d)
    return sorted(((d, f"{fps[k]:016x}", least.get(root(k))) for k, (d, _) in enumerate(rows)), key=repr)


@pytest.mark.parametrize("hot_cell", [simhash.HOT_CELL, 2])
def test_simhash_equals_brute_force(corpus, hot_cell):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert rows_of(simhash.near_duplicates(corpus, hot_cell=hot_cell), "doc_id", "fingerprint", "component_id") == brute_components(rows)


def test_simhash_links_dense_fingerprints(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 4)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for c in centres for _ in range(60)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    for hot in (simhash.HOT_CELL, 5):
        roots = {r.node: r.root for r in common.components(simhash.links(nodes, hot_cell=hot), "test").collect()}
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a in fps:
            for b in fps:
                if b < a and (a ^ b).bit_count() <= 3:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
        assert {f: roots.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_fingerprints_within_reach_share_a_cell(spark):
    rng = np.random.default_rng(7)
    pairs = []
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        pairs.append((a, a ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 12), replace=False))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(f)) for k, p in enumerate(pairs) for f in p], "k int, fp long")
    found = {}
    for r in df.select("k", "fp", simhash.embedded(df.fp).alias("e"), simhash.cells(df.fp).alias("c")).collect():
        counts = [(r.fp >> 2 * s & 1) + (r.fp >> 2 * s + 1 & 1) for s in range(32)]
        assert [(0, 1, 3)[n] for n in counts] == [r.e >> 2 * s & 3 for s in range(32)] and len(r.c) == 20
        found.setdefault(r.k, []).append((counts, {tuple(c) for c in r.c}))
    near = 0
    for k, ((x, c), (y, d)) in found.items():
        manhattan = sum(abs(p - q) for p, q in zip(x, y))
        assert manhattan <= (pairs[k][0] ^ pairs[k][1]).bit_count()
        near += manhattan <= 3
        assert manhattan > 3 or c & d
    assert near > 900


def test_one_id_on_different_texts_has_a_stable_choice(spark):
    rows = [(1, "a b c d e"), (1, "x y z q r s"), (2, "a b c d e"), (1, "a b c d e")]
    kept = {tuple(map(tuple, simhash.keep_one(spark.createDataFrame(part, "doc_id long, text string").repartition(n)).collect())) for part in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1


def test_simhash_keeps_one_of_each_group(corpus, nothing):
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(corpus).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, c in found if d == c)
    assert simhash.near_duplicates(nothing).collect() == [] and simhash.keep_one(nothing).collect() == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in common.components(edges, "path").collect()}
    assert found == {k: 0 for k in range(1, 201)} | {500: 400}


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, data):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((d, len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "k", "hot"), [(400, 128, 4096), (200, 64, 1024), (100, 40, 4096), (100, 40, 1), (30, 30, 4096)])
def test_repeats_equal_brute_force(corpus, length, k, hot):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    found = suffix_dedup.digest(corpus, length, k, hot)
    assert rows_of(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, length)


def test_removal_keeps_rows_and_columns(corpus, nothing):
    out = suffix_dedup.remove_repeats(corpus, 100, 40)
    assert out.columns == corpus.columns and out.count() == corpus.count()
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert suffix_dedup.remove_repeats(nothing).collect() == [] and suffix_dedup.digest(nothing).collect() == []


def test_index_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 6))]
        index = suffix_dedup.RunLengthIndex(strings)
        assert int(index.run_lengths.sum()) == index.size
        places = [(s, k) for s, t in enumerate(strings) for k in range(len(t))]

        def longest(s, k):
            best = 0
            for t, j in places:
                if (t, j) != (s, k):
                    n = 0
                    while k + n < len(strings[s]) and j + n < len(strings[t]) and strings[s][k + n] == strings[t][j + n]:
                        n += 1
                    best = max(best, n)
            return best

        found = index.matching_statistics()
        assert [int(found[index.starts[s] + k]) for s, k in places] == [longest(s, k) for s, k in places]


def test_clashing_columns(corpus):
    odd = corpus.limit(8).selectExpr("doc_id", "text", "1 as fingerprint", "2 as row", "3 as d", "4 as __x", "5 as ranges")
    assert simhash.keep_one(odd).columns == odd.columns
    assert suffix_dedup.remove_repeats(odd).columns == odd.columns
