"""Near copies by Jaccard similarity: SimHash's grid and bands of minimum hashes propose, an exact comparison of sets decides.

A text's set has the 64-bit hashes of its five-word shingles (lower case, any white space; a shorter text is one shingle).
Its SimHash fingerprint is over that set, and fingerprints meet on the grid of segment bit counts of `simhash`: whatever
differences of at most three bits connect is a cell. Texts of similarity 0.8 may lie farther apart than the grid reaches, so
BANDS fingerprints of ROWS minimum hashes each are cells as well: two texts of similarity s share none with probability
(1 - s^5)^25, 5 in 100,000 at 0.8 and less above. Distinct texts are compared, so copies cost nothing; of cells with the
same texts one is kept. Only cells leave the first pass over the texts; sets are made anew for the texts that share a cell,
which are few. The sets of a cell's texts are compared exactly, unless links already connect them, and a spanning forest
leaves the task, never the pairs of a group. A cell of more than HOT_CELL texts or HOT_SHINGLES shingles is cut into
chunks, and every two chunks meet in a task of their own: exact, in bounded memory.

One row of each component stays, whichever ids rows have: the one with the least doc_id (null last), then the least hash
of id and text; of equal rows one.

Defined cases: texts without words (null too) are copies of each other and like no other text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, frugal, session, texts, unused, written
from .simhash import LOWER, links, majority

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 5
HOT_CELL, HOT_SHINGLES = 20_000, 4_000_000
_RANDOM = np.random.default_rng(20)
_XOR = _RANDOM.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
_TIMES, _MIX = (_RANDOM.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in ((BANDS * ROWS, 1), (BANDS, ROWS)))


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; none without words."""
    import xxhash

    h = xxhash.xxh64_intdigest
    runs = [b" ".join(words[k : k + shingle]) for k in range(max(len(words) - shingle + 1, min(len(words), 1)))]
    return np.unique(np.array([h(run, 42) for run in runs], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The cells of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[k : k + 4096] ^ _XOR) * _TIMES).min(1))
    mixed = (least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIX
    return mixed.sum(1, dtype=np.uint64)


def similar(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Links that connect whatever sets of this similarity connect."""
    sizes = np.array([len(s) for s in sets])
    parts = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(sizes)[:-1])
    mark = np.zeros(int(sizes.sum()), bool)
    group, found = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        others = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        others = others[np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i]) - 1e-9]
        if not len(others):
            continue
        mark[parts[i]] = True
        ends = np.cumsum(sizes[others])
        both = np.add.reduceat(mark[np.concatenate([parts[j] for j in others])], ends - sizes[others], dtype=np.int64)
        mark[parts[i]] = False
        for j in others[both >= threshold * (sizes[i] + sizes[others] - both) - 1e-9].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                found.append((i, j))
    return found


def _hash() -> Column:
    return F.xxhash64("doc_id", "text")


def _cells(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, node, size, cells, fp): h is a hash of doc_id and text as they stand, node of the words, size that of their set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            node, sizes, cells, fps = [], [], [], []
            for text in texts(batch):
                words = text.translate(LOWER).split()
                found = shingles(words, shingle)
                node.append(xxhash.xxh64_intdigest(b" ".join(words), 7))
                sizes.append(len(found))
                cells.append(bands(found).view(np.int64) if words else [])
                fps.append(majority(found))
            node, fps = (pa.array(np.array(hashes, np.uint64).view(np.int64)) for hashes in (node, fps))
            columns = [node, pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64())), fps]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns], ["doc_id", "h", "node", "size", "cells", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", _hash().alias("h"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, h long, node long, size long, cells array<long>, fp long")


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(text.translate(LOWER).split(), shingle).tobytes() for text in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return run


def _linked(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of each cell; the rows of a cell follow each other."""

        def of_cell(sets: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
            nodes = list(sets)
            if pairs := similar([np.frombuffer(s, np.uint64) for s in sets.values()], threshold) if len(nodes) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

        now, sets = None, {}
        for batch in batches:
            for cell, node, data in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "shingles"))):
                if cell != now:
                    yield from of_cell(sets)
                    now, sets = cell, {}
                sets[node] = data
        yield from of_cell(sets)

    return run


def _close(nodes: DataFrame, hot_cell: int) -> DataFrame:
    """(node, size, cell): a cell has the texts that SimHash connects; those without words have none."""
    worded = nodes.where("size > 0").select("node", "size", "fp")
    roots = components(links(worded.select("fp").distinct(), hot_cell=hot_cell), "near-simhash").withColumnRenamed("node", "linked")
    root = F.coalesce("root", "fp")
    rooted = worded.join(roots, worded["fp"] == roots["linked"], "left").select("node", "size", F.xxhash64(F.lit("simhash"), root).alias("cell"))
    close = written(rooted, "near-close")
    discard(roots)
    return close


def near_components(docs: DataFrame, nodes: DataFrame, shingle: int, threshold: float, hot_cell: int, hot_shingles: int = HOT_SHINGLES) -> DataFrame:
    """(node, root) for the nodes (node, h, size, cells, fp) that have a link; texts come from docs, by h."""
    close = _close(nodes, hot_cell)
    members = nodes.select("node", "size", F.explode("cells").alias("cell")).union(close)
    # The nodes are hashes: their exclusive or and number tell the members of cells apart.
    stats = members.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor("node").alias("all")).where("n > 1")
    shared = written(stats, "near-shared")
    chunks = F.greatest(F.ceil(F.col("n") / hot_cell), F.ceil(F.col("total") / hot_shingles)).cast("long")
    kept = shared.groupBy("n", "total", "all").agg(F.min("cell").alias("cell")).select("cell", chunks.alias("n"))
    mine = F.pmod(F.xxhash64("node"), F.col("n"))
    placed = members.join(kept, "cell").select("node", "cell", "n", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    pair = F.when(F.col("n") == 1, F.col("cell")).otherwise(F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other")))
    placed = written(placed.select("node", pair.alias("cell")), "near-cells")
    discard(shared, close)
    asked = written(nodes.select("node", "h").join(placed.select("node").distinct(), "node", "left_semi"), "near-asked")
    own = docs.select(_hash().alias("h"), F.col("text").cast("string").alias("text"))
    sets = own.join(asked, "h").select("node", "text").mapInArrow(frugal(_sets(shingle)), "node long, shingles binary")
    sets = written(sets.dropDuplicates(["node"]), "near-sets")
    links = placed.join(sets, "node").repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(_linked(threshold)), "a long, b long")
    roots = components(links, "near-links")
    discard(placed, asked, sets)
    return roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, hot_cell: int = HOT_CELL) -> DataFrame:
    """docs with one row of each component of near copies."""
    session(docs.sparkSession)
    key = unused(docs, "own_hash")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    nodes = _cells(docs, shingle).groupBy("node").agg(least, *(F.first(c).alias(c) for c in ("size", "cells", "fp")))
    nodes = written(nodes.withColumn("h", F.col("least.h")), "near-nodes")
    roots = near_components(docs, nodes, shingle, threshold, hot_cell).withColumnRenamed("node", "linked")
    rooted = nodes.join(roots, nodes["node"] == roots["linked"], "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = written(rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.h").alias(key)).distinct(), "near-kept")
    discard(nodes, roots)
    # One key for the join and for equal rows: texts are shuffled once.
    found = docs.withColumn(key, _hash()).join(kept, key, "left_semi").dropDuplicates([key])
    return found.select(docs.columns)
