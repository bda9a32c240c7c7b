"""The pipeline against a plain run of its rules."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tesserae.llm import toxicity

from .conftest import words
from .test_near import brute_kept
from .test_texts import brute_hits, brute_ids


def brute_cut_repeats(rows, length):
    from collections import Counter

    data = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, data):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        out.append((d, bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The smallest tables, with labelled insults (some hidden), null and empty texts and copies."""
    rng = random.Random(21)
    root = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows, marks = [], []
    for k in range(120):
        insult = rng.choice(["zorgblat", "quimble"]) if k % 2 else ""
        if k % 20 == 1:
            insult = insult.replace("l", "1").replace("b", "8")
        rows.append((10**6 + k, f"{words(rng, 40)} {insult} {words(rng, 30)}", "en", "s", 1))
        marks.append((10**6 + k, k % 2))
    rows += [(2 * 10**6, None, "en", "s", 0), (2 * 10**6 + 1, "", None, None, None), (2 * 10**6 + 2, rows[0][1], "en", "s", 1), (2 * 10**6 + 3, rows[0][1] + " end", "en", "s", 1)]
    extra = spark.createDataFrame(rows, docs.schema)
    docs.union(extra).repartition(4).write.parquet(f"{root}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = spark.createDataFrame(marks, "doc_id long, toxic int").selectExpr("doc_id", "1 - toxic as quality", "toxic").select(labels.columns)
    labels.union(own).write.parquet(f"{root}/labels.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_pipeline_equals_a_plain_run(spark, tables):
    """All rules by brute force: scores text by text, sets of shingles, all substrings, all windows, whole-text ids."""
    sf_dir = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    model = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect() if model.score(r.text or "") < 0.7]
    assert len(rows) == docs.count() - 60
    rows = [min(group, key=lambda r: r[0]) for group in brute_kept(rows)]
    rows = brute_cut_repeats(rows, corpus_pipeline.REPEAT_BYTES)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted({p.sequence_id for p in pieces}) == list(range(len({p.sequence_id for p in pieces})))
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start * 4 == len(whole.get(p.doc_id, b""))
        whole[p.doc_id] = whole.get(p.doc_id, b"") + bytes(p.ids)
    kept = 0
    for d, text in rows:
        n, hit, _ = brute_hits(text, items, 13)
        if hit and hit >= 0.5 * n:
            assert d not in whole
            continue
        kept += 1
        if not hit:  # how passages are cut out is tested with the operator
            assert np.frombuffer(whole[d], "<u4").tolist() == brute_ids(text)
        else:
            assert 0 < len(whole[d]) < 4 * len(brute_ids(text))
    assert kept == len(whole)


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(11)
    passage = " ".join(words(rng, 200).split()[:51])
    assert len(passage.split()) == 51 and len(passage.encode()) >= corpus_pipeline.REPEAT_BYTES
    line = words(rng, 12)
    rows = [(k, f"{words(rng, 90)} {passage if k % 3 == 0 else line} {words(rng, 90)}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, text in rows:
        assert (passage not in out[k] and len(out[k]) <= len(text) - len(passage)) if k % 3 == 0 else out[k] == text
