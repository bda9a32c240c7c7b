"""SimHash near-duplicates: a segment-popcount grid join, then exact verification.

A fingerprint of 64 bits is embedded as the bit counts of its 32 segments of two bits. The Manhattan distance of two such
vectors is a lower bound of the Hamming distance. Vectors within a Manhattan distance of three differ in at most three
segments, so of the six groups that the segments are dealt to, three agree: the grid's cells are the counts of any three
groups (20 of them), and every two vectors within range share one. Within a cell the Manhattan distance is taken first
and the Hamming distance last; a spanning forest of the links leaves the task, never the pairs of a group.

The counts are kept in unary, a segment's bits sorted: then the Manhattan distance is the bit count of an exclusive or,
and a cell is a mask. Three groups have 15 to 17 segments, some 24 bits of information in random fingerprints: a cell's
partners are fewer than those that share 16 bits, and 20 rows a fingerprint are shuffled.

Distinct fingerprints are compared, so copies cost nothing. A cell with more than HOT_CELL fingerprints is
cut into chunks of that size, and every two chunks meet in a task of their own: exact, in bounded memory.

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other; repeated
rows and ids each get a row; a null doc_id never names a component unless it has no other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, frugal, roots_of, session, texts, unused, written

HOT_CELL = 20_000
#: So many rows of whole cells are compared at once; a single cell may have twice HOT_CELL.
HELD_ROWS = 200_000
#: The greatest distance that the grid finds; segments are dealt to twice as many groups.
REACH, GROUPS = 3, 6
#: The low bit of each segment.
LOW = 0x5555555555555555
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of the text's word shingles."""
    import xxhash

    norm = b" ".join(text.translate(LOWER).split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) + 1 <= shingle:
        hashes = [xxhash.xxh64_intdigest(norm, 42)]
    else:
        h = xxhash.xxh64_intdigest
        starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(norm)]
        hashes = [h(norm[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            out = []
            for text in texts(batch):
                if (fp := seen.get(text)) is None:
                    fp = seen[text] = fingerprint(text, shingle)
                out.append(fp)
            fps = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), f"doc_id {kind}, fp long")


def embedded(fp: Column) -> Column:
    """The bit counts of the segments in unary: each segment's bits, sorted."""
    low, high = fp.bitwiseAND(LOW), F.shiftrightunsigned(fp, 1).bitwiseAND(LOW)
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def cells(fp: Column) -> Column:
    """The grid's cells of a fingerprint: which groups, and their segments' counts."""
    groups = [sum(3 << 2 * s for s in range(32) if s % GROUPS == g) for g in range(GROUPS)]
    masks = [sum(c) for c in combinations(groups, GROUPS - REACH)]
    return F.array(*(F.struct(F.lit(n).alias("mask"), embedded(fp).bitwiseAND(F.lit(_signed(m))).alias("counts")) for n, m in enumerate(masks)))


def _cell_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of the links within cells; the rows of a cell follow each other, and some whole cells are taken at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column("cell").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last and sum(len(k) for k, _ in held) + last >= HELD_ROWS:
            yield from _forest([*held, (key[:last], fp[:last])], distance)
            held, key, fp = [], key[last:], fp[last:]
        held.append((key, fp))
    yield from _forest(held, distance)


def _forest(held: list[tuple[np.ndarray, np.ndarray]], distance: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    key, fp = map(np.concatenate, zip(*held))
    node, at = np.unique(fp, return_inverse=True)
    low, high = fp & np.uint64(LOW), fp >> np.uint64(1) & np.uint64(LOW)
    counts = low | high | (low & high) << np.uint64(1)
    parent, links = np.arange(len(node)), []
    left, step = np.arange(len(key)), 0
    while True:
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left] == key[left + step]]
        if not len(left):
            break
        a, b = left, left + step
        near = np.bitwise_count(counts[a] ^ counts[b]) <= distance
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = at[a[near]], at[b[near]]
        if len(a):
            apart = roots_of(parent, a) != roots_of(parent, b)
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                p, q = x, y
                while parent[p] != p:
                    parent[p] = p = parent[parent[p]]
                while parent[q] != q:
                    parent[q] = q = parent[parent[q]]
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    links.append((x, y))
    if links:
        pairs = np.array(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[pairs[:, k]].view(np.int64)) for k in (0, 1)], ["a", "b"])


def links(nodes: DataFrame, distance: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """(a, b): links that connect whatever fingerprints (column fp, distinct) within the distance connect."""
    if not 0 <= distance <= REACH:
        raise ValueError("the grid finds differences of at most three bits")
    placed = nodes.select("fp", F.explode(cells(F.col("fp"))).alias("c")).select("fp", F.xxhash64("c.mask", "c.counts").alias("cell"))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    # A cell of one fingerprint links nothing.
    sizes = written(sizes.select("cell", F.ceil(F.col("n") / hot_cell).cast("long").alias("n")), "simhash-cells")
    placed = placed.join(sizes, "cell")
    mine = F.pmod(F.xxhash64("fp"), F.col("n"))
    placed = placed.select("fp", "cell", "n", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    pair = F.xxhash64("cell", F.least("mine", "other"), F.greatest("mine", "other"))
    placed = placed.select("fp", F.when(F.col("n") == 1, F.col("cell")).otherwise(pair).alias("cell"))
    return placed.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(lambda x: _cell_links(x, distance)), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, hot_cell: int = HOT_CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach), a row per row of docs."""
    session(docs.sparkSession)
    rows = written(fingerprints(docs, shingle), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = components(links(nodes, distance, hot_cell), "simhash-links")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "simhash-named")
    discard(nodes, roots)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs without the rows that have a near-duplicate of lesser doc_id; of rows with one id, the one with the least hash of its text stays."""
    found = near_duplicates(docs, shingle, distance)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    key = unused(docs, "own_hash")
    own = docs.withColumn(key, F.xxhash64("text")).join(kept, "doc_id", "left_semi")
    first = own.groupBy("doc_id").agg(F.min(key).alias(key))
    one = own.join(first, ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return one.select(docs.columns).union(docs.where(F.col("doc_id").isNull()))
