"""The pipeline's near-duplicate stage against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tesserae.llm import near

from .conftest import COLUMNS, words


def brute_set(text):
    found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {b" ".join(found[k : k + 5]) for k in range(max(len(found) - 4, 1))} if found else set()


def brute_kept(rows):
    """The rows (id, text) that stay, distinct."""
    sets, parent = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(root(k), []).append(row)
    return groups.values()


def brute_fingerprint(shingles):
    """A bit is set if it is in over half of the hashes."""
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.fixture(scope="module")
def edited(corpus, spark):
    """Texts with so many changed words that fingerprints are far apart, and a little fewer shared shingles than needed."""
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = words(rng, 200).split()
        rows.append((1000 + 10 * k, " ".join(base), "en", "s", 1))
        for v, changed in enumerate((2, 3, 4, 5, 7, 12)):
            copy = list(base)
            for at in rng.sample(range(200), changed):
                copy[at] = "changed" + str(rng.random())
            rows.append((1001 + 10 * k + v, " ".join(copy), "en", "s", 1))
    return corpus.union(spark.createDataFrame(rows, COLUMNS)).repartition(4).persist()


@pytest.mark.parametrize("hot_cell", [near.HOT_CELL, 2])
def test_near_copies_equal_brute_force(edited, hot_cell):
    rows = [(r.doc_id, r.text) for r in edited.collect()]
    kept = near.keep_one(edited, hot_cell=hot_cell)
    assert kept.columns == edited.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute_kept(rows)
    assert len(found) == len(groups)
    for group in groups:
        own = [r for r in found if r in group]
        assert len(own) == 1 and (own[0][0] is None) == all(d is None for d, _ in group)
        assert own[0][0] == min((d for d, _ in group if d is not None), default=None)


def test_pipeline_stage_has_its_own_parameters(edited, nothing, spark):
    rows = [(r.doc_id, r.text) for r in edited.collect()]
    assert corpus_pipeline.drop_near_copies(spark, edited, "").count() == len(brute_kept(rows))
    assert corpus_pipeline.drop_near_copies(spark, nothing, "").collect() == []


def test_simhash_proposes_near_copies(spark, monkeypatch):
    """With bands that no two sets share, what is left is what SimHash connects and the exact comparison confirms."""
    monkeypatch.setattr(near, "bands", lambda hashes: np.full(25, hashes.sum(), np.uint64))
    rng = random.Random(13)
    rows = []
    for k in range(30):
        base = words(rng, 400).split()
        rows.append((10 * k, " ".join(base)))
        for v, changed in enumerate((1, 2, 8, 25)):
            copy = list(base)
            for at in rng.sample(range(400), changed):
                copy[at] = f"changed{at}"
            rows.append((10 * k + 1 + v, " ".join(copy)))
    sets = [brute_set(t) for _, t in rows]
    fps = [brute_fingerprint(s) for s in sets]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    close = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    cells = list(range(len(rows)))
    for a, b in close:
        cells = [cells[b] if c == cells[a] else c for c in cells]
    for a in range(len(rows)):
        for b in range(a):
            if cells[a] == cells[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    left = {rows[root(k)][0] for k in range(len(rows))}
    assert 60 < len(left) < 140
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot_cell in (near.HOT_CELL, 2):
        assert sorted(r.doc_id for r in near.keep_one(docs, hot_cell=hot_cell).collect()) == sorted(left)


def test_one_id_on_different_texts_loses_none(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (1, "a  b c d e f g"), (None, "o p q r s t u"), (None, "o p q r s t u"), (2, "H i j k l m n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text.lower().split()[0]) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(kept, key=repr) == [(1, "a"), (1, "h"), (None, "o")]


def test_clashing_columns(spark, corpus):
    odd = corpus.limit(8).selectExpr("doc_id", "text", "1 as own_hash", "2 as h", "3 as node", "4 as cell", "5 as root")
    out = near.keep_one(odd)
    assert out.columns == odd.columns and {(r.own_hash, r.h, r.root) for r in out.collect()} == {(1, 2, 5)}
