"""Long repeated substrings, found with run-compressed Burrows-Wheeler indexes, and removed.

A byte goes if a string of `length` bytes that covers it also starts anywhere else in the corpus; matches never cross
documents. The work is cut up so that no index holds more than a bounded part of the corpus:

1. Every string of `length` bytes has one anchor, its leftmost least K-gram by hash. Equal strings have equal anchors,
   so strings of different anchors need no comparison. Neighbouring strings with the same anchor occurrence form a
   context, a stretch of text; a string belongs to exactly one context.
2. An anchor that occurs once repeats nothing. Of the others, a context that occurs twice as it stands repeats wholly;
   only distinct contexts of one anchor go on, one copy of each.
3. The contexts of a share of the anchors form a text for which a run-compressed Burrows-Wheeler transform is built.
   Its samples, at the first and last row of each run, give the longest common prefix with the row before and behind.
   From these the matching statistics of all other positions follow, each one less than its predecessor's. A start
   whose statistic reaches `length` repeats.
4. An anchor with more than HOT_CONTEXTS distinct contexts (a passage in very many documents, at its edges) isn't put
   in one index. Its strings are halved by the offset of the anchor in them: a range of offsets is done with for a
   context if no other one has the bytes that all strings of the range share, or if one has all bytes of the range.
   Groups are counted by hash, so none meets in one task, and few rows are made per context. This is exact as well.

Documents meet contexts and marks by digest, so copies are handled once.

Defined cases: a null or empty text has no bytes and nothing removed; repeated rows are copies of each other; a text
shorter than `length` stays whole. In `remove_repeats`, a character that loses some of its bytes goes entirely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, session, texts, tidy, written

K = 128
PIECE = 1 << 16
HOT_CONTEXTS, INDEX_BYTES = 1024, 120_000
#: Ranges of 2 ** TOP_LEVEL offsets are what halving begins with.
TOP_LEVEL = 5
_POSITION = np.uint64((1 << 21) - 1)
_tables: dict[int, tuple[np.ndarray, ...]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte value, and the powers of an odd base and of its inverse modulo 2 ** 64."""
    if not _tables or len(_tables[0][1]) < n:
        size = max(n, 1 << 15)
        base = 0x9E3779B97F4A7C15 | 1
        inverse = pow(base, -1, 1 << 64)
        up, down = np.full(size, base, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _tables[0] = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64), np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[0]


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k bytes in a row."""
    values, up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, from least values of blocks up to and from each place."""
    n = len(values)
    blocks = np.pad(values, (0, -n % width), constant_values=np.iinfo(values.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(docs: list[bytes], length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, anchor hash, anchor's place, first start, last start) of the contexts: arrays for about PIECE bytes of documents at a time.

    Longer documents are cut into pieces of starts, each with the bytes that its last start needs.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for n, text in enumerate(docs):
        for begin in range(0, len(text) - length + 1, PIECE):
            part = text[begin : begin + PIECE + length - 1]
            held.append((n, begin, part))
            size += len(part)
            if size >= PIECE:
                yield _contexts(held, length, k)
                held, size = [], 0
    if held:
        yield _contexts(held, length, k)


def _contexts(held: list[tuple[int, int, bytes]], length: int, k: int) -> tuple[np.ndarray, ...]:
    hashes = gram_hashes(np.frombuffer(b"".join(x[2] for x in held), np.uint8), k)
    keyed = (hashes & ~_POSITION) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (_least(keyed, length - k + 1) & _POSITION).astype(np.int64)
    sizes = np.array([len(x[2]) for x in held], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # Starts whose strings reach into the next document are none.
    edge = np.zeros(len(anchor) + 1, np.int8)
    edge[begins] += 1
    edge[ends - length + 1] -= 1
    inside = np.cumsum(edge[:-1]).astype(bool)
    new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new[begins] = True
    first = np.flatnonzero(inside & new)
    last = np.append(first[1:], len(anchor)) - 1
    owner = np.searchsorted(ends, first, "right")
    last = np.minimum(last, ends[owner] - length)
    back = np.array([x[1] for x in held], np.int64)[owner] - begins[owner]
    at = anchor[first]
    return np.array([x[0] for x in held], np.int64)[owner], hashes[at].view(np.int64), at + back, first + back, last + back


class RunLengthIndex:
    """A run-compressed Burrows-Wheeler transform of several strings, with samples at the ends of its runs.

    The text is all strings, each with a zero byte behind it; zero bytes within strings don't matter, as starts are judged
    by the distance to their string's end too.
    """

    def __init__(self, strings: list[bytes]):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        self.size = n = len(text)
        self.room = np.repeat(self.starts + sizes, sizes + 1) - np.arange(n)
        ranks, lengths = self._ranks(text)
        suffixes = np.empty(n, np.int64)
        suffixes[ranks[-1]] = np.arange(n)
        before = text[suffixes - 1].astype(np.int16)
        before[ranks[-1][0]] = -1  # before the first position there is nothing: a run of its own
        change = np.flatnonzero(before[1:] != before[:-1]) + 1
        heads, tails = np.concatenate(([0], change)), np.append(change, n) - 1
        self.characters, self.run_lengths = before[heads], np.diff(np.append(heads, n))
        self.head_samples = suffixes[heads], self._common(text, ranks, lengths, suffixes, heads, heads - 1)
        self.tail_samples = suffixes[tails], self._common(text, ranks, lengths, suffixes, tails, tails + 1)

    @staticmethod
    def _ranks(text: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """The ranks of all substrings of 7, 14, 28 ... bytes (the text's end is less than any byte), until all are distinct."""
        n = len(text)
        padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)))
        key = padded[:n].copy()
        for k in range(1, 7):
            key = key * np.uint64(257) + padded[k : n + k]
        ranks, lengths = [], [7]
        while True:
            order = np.argsort(key)
            ordered = key[order]
            rank = np.empty(n, np.int32)
            steps = np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32)
            rank[order[:1]] = 0
            rank[order[1:]] = steps
            ranks.append(rank)
            if n == 1 or steps[-1] == n - 1:
                return ranks, lengths
            step = lengths[-1]
            key = rank.astype(np.uint64) << np.uint64(32)
            key[: max(0, n - step)] |= (rank[step:] + 1).astype(np.uint64)
            lengths.append(2 * step)

    @staticmethod
    def _common(text: np.ndarray, ranks: list[np.ndarray], lengths: list[int], suffixes: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The length of the common prefix of the suffixes in the rows; 0 beyond the first or last row."""
        n = len(suffixes)
        common = np.zeros(len(rows), np.int64)
        at = np.flatnonzero((others >= 0) & (others < n))
        a, b = suffixes[rows[at]], suffixes[others[at]]
        shared = np.zeros(len(at), np.int64)
        for rank, length in zip(reversed(ranks), reversed(lengths)):
            x, y = a + shared, b + shared
            same = rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)]
            shared[same & (np.maximum(x, y) < n)] += length
        for _ in range(6):  # the shortest ranks are those of seven bytes
            x, y = a + shared, b + shared
            shared += (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]) & (np.maximum(x, y) < n)
        common[at] = shared
        return common

    def matching_statistics(self) -> np.ndarray:
        """For each position (the strings' ends included), the longest prefix, within its string, that also starts elsewhere."""
        best, places = np.zeros(self.size, np.int64), np.arange(self.size)
        for sampled, common in (self.head_samples, self.tail_samples):
            # From a sample on, each position's value is one less than the one before, up to the next sample.
            last, value = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
            last[sampled], value[sampled] = sampled, common
            last = np.maximum.accumulate(last)
            best = np.maximum(best, value[last] - (places - last))
        return np.minimum(best, self.room)

    def repeats(self, length: int) -> list[list[tuple[int, int]]]:
        """For each string, the ranges of starts (from, to) whose `length` symbols also start elsewhere."""
        flags = np.concatenate((self.matching_statistics() >= length, [False])).astype(np.int8)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], flags))))
        string = np.searchsorted(self.starts, edges[::2], "right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.starts]
        for s, a, b in zip(string.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
            out[s].append((a - int(self.starts[s]), b - int(self.starts[s])))
        return out


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn("text", text).withColumn("__digest", F.unhex(F.md5(text.cast("binary"))))


def _anchors(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        h = xxhash.xxh3_64_intdigest
        for batch in batches:
            docs = texts(batch)
            for owner, anchor, at, first, last in contexts(docs, length, k):
                whole = [h(docs[n][a : b + length]) for n, a, b in zip(owner.tolist(), first.tolist(), last.tolist())]
                d = batch.column("__digest").take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([d, pa.array(anchor), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array((at - first).astype(np.int32)), pa.array(first), pa.array(last)], ["d", "h", "ctx", "at", "lo", "hi"])

    return run


def _extract(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(texts(batch), batch.column("wanted").to_pylist()):
                columns = [pa.array([w[c] for w in wanted], pa.int64()) for c in ("h", "ctx", "n", "at")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([text[w["lo"] : w["hi"] + length] for w in wanted], pa.binary())], ["h", "ctx", "n", "at", "bytes"])

    return run


def _indexed(length: int):
    """Index after index over whole anchors, in the order of the partition."""

    def marks(held: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        found = RunLengthIndex([b for _, _, b in held]).repeats(length)
        rows = [(h, ctx, a, b) for (h, ctx, _), ranges in zip(held, found) for a, b in ranges]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["h", "ctx", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for h, ctx, data in zip(*(batch.column(c).to_pylist() for c in ("h", "ctx", "bytes"))):
                if size >= INDEX_BYTES and h != held[-1][0]:
                    yield from marks(held)
                    held, size = [], 0
                held.append((h, ctx, data))
                size += len(data)
        if held:
            yield from marks(held)

    return run


def _halved(hot: DataFrame, length: int, k: int, tables: list[DataFrame]) -> DataFrame:
    """(h, ctx, a, b) for the contexts (h, ctx, at, bytes) of hot anchors, by halving the ranges of the anchor's offset.

    A string that starts `o` bytes before the anchor has the offset o. A context has the offsets at - starts + 1 to at.
    The written tables that the result reads are added to `tables`.
    """
    top = length - k
    level = TOP_LEVEL
    n_starts = F.octet_length("bytes") - (length - 1)
    first = F.floor(F.greatest(F.col("at") - n_starts + 1, F.lit(0)) / 2**level)
    state = hot.select("h", "ctx", "at", "bytes", F.explode(F.sequence(first, F.floor(F.col("at") / 2**level))).alias("node"), F.lit(False).alias("done"))
    marks = []
    while True:
        low, high = F.col("node") * 2**level, F.least(F.col("node") * 2**level + (2**level - 1), F.lit(top))
        piece = lambda left, right: F.xxhash64(F.substring(F.col("bytes"), F.col("at") - left + 1, left + k + right))
        rows = state.where((low <= F.col("at")) & (high >= F.col("at") - n_starts + 1))
        rows = rows.withColumns({"low": low, "high": high})
        rows = rows.withColumn("core", piece(F.col("low"), top - F.col("high")))
        # A context that is done with stays as a partner of those that aren't.
        shared = rows.groupBy("h", "node", "core").agg(F.count("*").alias("n"), F.min("done").alias("all_done")).where("n > 1 and not all_done").drop("n", "all_done")
        rows = rows.join(shared, ["h", "node", "core"], "left_semi")
        # Of contexts that are alike in all their strings of the range, one stays as a partner of the others.
        least, most = F.greatest(F.col("low"), F.col("at") - n_starts + 1), F.least(F.col("high"), F.col("at"))
        rows = rows.withColumns({"least": least, "most": most})
        rows = written(rows.withColumn("whole", F.xxhash64("least", "most", piece(F.col("most"), top - F.col("least")))), "suffix-halves")
        tables.append(rows)
        alike = rows.groupBy("h", "node", "whole").agg(F.count("*").alias("alike"), F.min("ctx").alias("stays")).where("alike > 1")
        rows = rows.join(alike, ["h", "node", "whole"], "left")
        marks.append(rows.where("alike is not null and not done").select("h", "ctx", (F.col("at") - F.col("most")).cast("long").alias("a"), (F.col("at") - F.col("least") + 1).cast("long").alias("b")))
        if not level:
            break
        level -= 1
        rest = rows.where("alike is null or ctx = stays").select("h", "ctx", "at", "bytes", "node", (F.col("done") | F.col("alike").isNotNull()).alias("done"))
        state = rest.withColumn("node", F.col("node") * 2).union(rest.withColumn("node", F.col("node") * 2 + 1))
    out = marks[0]
    for m in marks[1:]:
        out = out.union(m)
    return out


def repeats(docs: DataFrame, length: int = 400, k: int = K, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """(d, ranges): by the MD5 digest of a text, the ranges of starts (a, b) of strings that also start elsewhere."""
    if not 0 < k <= length:
        raise ValueError("an anchor isn't longer than the strings")
    spark = session(docs.sparkSession)
    source = _digested(docs.select("text"))
    anchors = written(source.mapInArrow(frugal(_anchors(length, k)), "d binary, h long, ctx long, at int, lo long, hi long"), "suffix-anchors")
    often = anchors.groupBy("h").agg(F.count("*").alias("n"), (F.min("ctx") != F.max("ctx")).alias("varied")).where("n > 1").drop("n")
    # Read back, both sides of the join are plain, and Spark can split the partitions of anchors that are very common.
    often = written(often, "suffix-often")
    shared = written(anchors.join(often, "h"), "suffix-shared")
    discard(anchors, often)
    kinds = shared.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.first("varied").alias("varied"), F.min(F.struct("d", "lo", "hi", "at")).alias("one"))
    kinds = written(kinds, "suffix-contexts")
    wanted = kinds.where("varied").groupBy(F.col("one.d").alias("d")).agg(F.collect_list(F.struct("h", "ctx", "n", "one.at", "one.lo", "one.hi")).alias("wanted"))
    once = source.where(F.octet_length("text") >= length).withColumnRenamed("__digest", "d").dropDuplicates(["d"])
    bodies = once.join(wanted, "d").select("text", "wanted").mapInArrow(_extract(length), "h long, ctx long, n long, at long, bytes binary")
    bodies = written(bodies, "suffix-bodies")
    sizes = written(bodies.groupBy("h").count().where(F.col("count") > hot_contexts).select("h"), "suffix-sizes")
    cool = bodies.join(sizes, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    hot = written(bodies.join(sizes, "h", "left_semi"), "suffix-hot")
    marks = cool.mapInArrow(frugal(_indexed(length)), "h long, ctx long, a long, b long")
    halves: list[DataFrame] = []
    with tidy(spark):
        some = not hot.isEmpty()
    if some:
        marks = marks.union(_halved(hot, length, k, halves))
    whole = kinds.where("n > 1").select("h", "ctx", F.lit(0).cast("long").alias("a"), F.lit(1 << 40).alias("b"))
    marks = written(whole.union(marks.join(kinds.where("n > 1").select("h", "ctx"), ["h", "ctx"], "left_anti")), "suffix-marks")
    discard(bodies, sizes, hot, kinds, *halves)
    found = shared.select("d", "h", "ctx", "lo", "hi").distinct().join(marks, ["h", "ctx"])
    span = F.struct((F.col("lo") + F.col("a")).alias("a"), F.least(F.col("lo") + F.col("b"), F.col("hi") + 1).alias("b"))
    ranges = written(found.groupBy("d").agg(F.collect_list(span).alias("ranges")), "suffix-ranges")
    discard(shared, marks)
    return ranges


def removed_spans(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings starting in the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length - 1) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _marked(docs: DataFrame, length: int, k: int, hot_contexts: int) -> DataFrame:
    """row (all columns of docs), text and ranges."""
    found = repeats(docs, length, k, hot_contexts)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"), "text")
    return _digested(rows).join(found.withColumnRenamed("d", "__digest"), "__digest", "left").select("row", "text", "ranges")


def digest(docs: DataFrame, length: int = 400, k: int = K, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, a row per row of docs."""
    marked = _marked(docs.select("doc_id", "text"), length, k, hot_contexts).select(F.col("row.doc_id").alias("doc_id"), "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(texts(batch), batch.column("ranges").to_pylist()):
                spans = removed_spans(ranges or [], length)
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(_cut(text, spans)).hexdigest()))
            n, removed, spans, sha = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 400, k: int = K, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """docs without repeated strings; every row stays, and n_chars, if there, is counted anew."""
    marked = _marked(docs, length, k, hot_contexts)
    kind = marked.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_cut(t, removed_spans(r, length)).decode("utf-8", "ignore") if r else t.decode() for t, r in zip(texts(batch), batch.column("ranges").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], ["row", "text"])

    out = marked.mapInArrow(run, f"row {kind}, text string")
    return out.select(*(F.col("text") if c == "text" else F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns))
