"""Compression classifier: Zstandard dictionaries from good and from bad text, and the size difference as a score.

A text's blocks are compressed with either dictionary; the difference of the two sizes, over the text's length, is
high for text that looks like the bad examples. A logistic curve, fitted on labelled rows that the dictionaries have
not seen, turns it and how far the whole text compresses into the probability of label 1.

Both are fitted on at most SAMPLE_ROWS labelled rows and SAMPLE_BYTES of text, and on no text longer than a hundredth of
SAMPLE_BYTES (240 kB); every text is scored whole, however long.

Defined cases: a null or empty text gets the base rate of label 1 among the sample; without rows of both labels every
score is that rate (0.5 without any row); repeated rows and ids each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import crc_mod, session, texts

SAMPLE_ROWS, SAMPLE_BYTES = 6_000, 24_000_000
DICTIONARY_BYTES, BLOCK, LEVEL = 112_640, 2048, 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    rate: float

    def compressors(self) -> list:
        import zstandard as z

        out = []
        for raw in (self.good, self.bad):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False))
        return [*out, z.ZstdCompressor(level=LEVEL, write_content_size=False)]

    def scores(self, docs: list[bytes]) -> list[float]:
        if not self.weights:
            return [self.rate] * len(docs)
        tools = self.compressors()
        x = np.array([features(d, tools) for d in docs]).reshape(-1, N_FEATURES)
        p = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40)))
        return [float(v) if d else self.rate for v, d in zip(p, docs)]


N_FEATURES = 5


def features(text: bytes, tools: list) -> list[float]:
    """1, the normalised size difference, the mean compressed share of the blocks and of the whole text, and their product."""
    n = len(text) or 1
    blocks = [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)]
    good, bad = (sum(len(t.compress(b)) - 6 for b in blocks) / n for t in tools[:2])
    whole = len(tools[2].compress(text)) / n
    difference, share = bad - good, (bad + good) / 2
    return [1.0, 10 * difference, share, min(whole, 2.0), 10 * difference * share]


def logistic(x: np.ndarray, y: np.ndarray, base: float, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; rows are weighted so that label 1 has the share base."""
    weight = np.where(y == 1, base / max(y.mean(), 1e-9), (1 - base) / max(1 - y.mean(), 1e-9))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (y - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard as z

    blocks = [s[k : k + BLOCK] for s in samples for k in range(0, len(s), BLOCK)]
    try:
        return z.train_dictionary(DICTIONARY_BYTES, blocks, level=LEVEL).as_bytes()
    except z.ZstdError:  # too little text to train on: the text itself
        return (b"".join(blocks) or b"\n")[-DICTIONARY_BYTES:].ljust(8, b"\n")


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    import zstandard as z

    base = labels.where(crc_mod("doc_id", modulus) != held_out).agg(F.avg(F.col("quality").cast("int"))).first()[0]
    if base is None:
        return Model(b"", b"", (), 0.5)
    rows = labelled.sample(docs, labels, "quality", modulus, held_out, sample_rows)
    # A single text never takes more than a hundredth of the bound on bytes: longer ones aren't learned from.
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "label", F.octet_length("text").alias("n"))
    sized = rows.where(F.col("n") <= sample_bytes // 100).orderBy(F.xxhash64("doc_id"), "text").limit(sample_rows)
    found, total = [], 0
    for r in sized.toLocalIterator():  # a row at a time, until the bound on bytes
        total += len(r.text)
        if total > sample_bytes:
            break
        found.append((bytes(r.text), r.label))
    halves = found[::2], found[1::2]
    good, bad = ([t for t, y in halves[0] if y == k and t] for k in (1, 0))
    y = np.array([y for t, y in halves[1] if t])
    if not good or not bad or len(set(y.tolist())) < 2:
        return Model(b"", b"", (), float(base))
    model = Model(_dictionary(good), _dictionary(bad), (0.0,) * N_FEATURES, float(base))
    tools = model.compressors()
    x = np.array([features(t, tools) for t, _ in halves[1] if t])
    model.weights = tuple(logistic(x, y, min(max(model.rate, 1e-3), 1 - 1e-3)).tolist())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, a row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = session(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch)
            distinct = list(dict.fromkeys(found))
            by_text = dict(zip(distinct, shared.value.scores(distinct)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([by_text[t] for t in found], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold)."""
    scored = score(docs, fit(docs, labels, modulus, held_out))
    return scored.select("doc_id", (crc_mod("doc_id", modulus) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
