"""Language-model scoring: prediction by partial matching over bytes, and add-one word counts beside it.

The model is a trie of byte contexts. Each training text is framed by zero bytes before and one behind it, and the counts
of its strings of ORDER + 1 bytes hold those of all shorter contexts. A symbol is coded in its longest context; if that
never preceded it, an escape (method C: distinct symbols over count plus distinct) leads to the next shorter context,
where symbols that the longer one has seen are excluded, down to a uniform choice among the symbols never seen. With
counts fixed, what a step costs depends on the context and the symbol alone, so the trie is unfolded into sorted tables
of costs per context length; a text's bytes are looked up in the longest one, and those not found go on to the next.

Texts are written in blocks of about BLOCK_BYTES. A block's distinct strings leave it as packed arrays per bucket, with
their counts in its training texts; a bucket has all strings whose contexts end in the same two bytes, so that what any of
them costs depends on its own bucket and on the counts of pairs of bytes, of which there are 65,536; there are the more
buckets the more text there is, up to one a pair. Counts are merged in
rounds of bounded width. The blocks' strings then stream past their bucket's tables, and the costs meet the block's texts
again. Contexts have five bytes whatever the size of the corpus, and only the counts of pairs are broadcast.

Word counts are exact over all training texts: a block asks for the counts of its distinct words too, joined by word (a
64-bit hash).

Defined cases: a null or empty text is its end alone; without training texts every byte costs log10(1/256) and N, V
and all counts are zero; repeated rows and ids each get a row and count as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, discard, frugal, session, texts, tidy, written
from .simhash import LOWER

ORDER, BLOCK_BYTES = 5, 16_000_000
FRAME, END = b"\0" * ORDER, b"\0"
BUCKETS, WIDTH = 256, 64
#: There is a bucket for so many bytes of text, up to one for each pair of bytes; what is returned doesn't depend on it.
BUCKET_BYTES, MOST_BUCKETS = 1 << 27, 1 << 16
#: The last stage has at most so many tasks.
MOST_PARTS = 100_000


def _framed(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts framed in one buffer, and the place of each text's first coded byte."""
    buffer = np.frombuffer(b"".join(x for d in docs for x in (FRAME, d, END)), np.uint8)
    sizes = np.array([len(d) + ORDER + 1 for d in docs], np.int64)
    return buffer, np.cumsum(sizes) - sizes + ORDER


def _keys(buffer: np.ndarray, n: int) -> np.ndarray:
    """Big-endian numbers of each n bytes in a row."""
    out = buffer[: len(buffer) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out <<= np.uint64(8)
        out |= buffer[k : len(buffer) - n + 1 + k]
    return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and the sums of their n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def string_counts(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ORDER + 1 bytes that end at a coded byte, and their counts."""
    if not docs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buffer, starts = _framed(docs)
    keep = np.ones(len(buffer), bool)
    for k in range(1, ORDER + 1):
        keep[starts - k] = False
    keys = np.sort(_keys(buffer, ORDER + 1)[keep[ORDER:]])
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def _packed(keys: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted keys and their counts, as planes of bytes, which compress well."""
    both = np.concatenate((np.diff(keys, prepend=np.uint64(0)), n.astype(np.uint64)))
    return both.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(np.uint64).reshape(-1)
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.uint64), both[half:].astype(np.int64)


def _bucketed(keys: np.ndarray, n: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, number of strings, packed) of the sorted strings, dealt by a hash of the context's last two bytes; buckets: a power of two."""
    pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    bucket = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - buckets.bit_length())).astype(np.uint8 if buckets <= 256 else np.uint16)
    order = np.argsort(bucket, kind="stable")
    keys, n, ends = keys[order], n[order], np.cumsum(np.bincount(bucket, minlength=buckets))
    for b, (start, end) in enumerate(zip([0, *ends.tolist()], ends.tolist())):
        if end > start:
            yield b, end - start, _packed(keys[start:end], n[start:end])


@dataclass
class Level:
    """The strings of one length: a context and a symbol each. Costs are negative log10 probabilities."""

    keys: np.ndarray  # sorted
    direct: np.ndarray  # of the symbol, nothing excluded
    log_count: np.ndarray
    contexts: np.ndarray  # sorted
    escape: np.ndarray  # from the context
    left: np.ndarray  # log10 of count plus distinct symbols of the next shorter context, without the symbols seen here
    onward: np.ndarray  # of an escape from that one too

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are among the strings, and whether they are."""
        return _find(self.keys, keys)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Trie:
    levels: list[Level]  # by the length of contexts

    @classmethod
    def of(cls, keys: np.ndarray, n: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], order: int = ORDER) -> Trie:
        """From the counts of a bucket's strings of order + 1 bytes, and those of all strings of two bytes."""
        if not len(pairs[0]):
            return cls([])
        keys, n = _summed(keys.astype(np.uint64), n.astype(np.int64)) if order > 1 else pairs
        levels: list[Level] = []
        counts = [(keys, n)]
        for k in range(order, 0, -1):
            counts.append(pairs if k == 2 else _summed(counts[-1][0] & np.uint64((1 << 8 * k) - 1), counts[-1][1]))
        shorter: tuple[np.ndarray, ...] = ()
        for length, (keys, n) in enumerate(reversed(counts)):
            if not len(keys):  # nothing of the bucket is known: all its strings start from shorter contexts
                break
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            distinct = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(n, first)
            context = context[first]
            if length:
                mask = np.uint64((1 << 8 * length) - 1)
                at, _ = _find(shorter[2], context & np.uint64((1 << 8 * (length - 1)) - 1))
                seen = np.add.reduceat(shorter[1][_find(shorter[0], keys & mask)[0]], first)
                left, kinds = shorter[3][at] - seen, shorter[4][at] - distinct
            else:
                left, kinds = np.zeros(1, np.int64), 256 - distinct
            some = kinds > 0
            onward = np.where(some, np.log10(np.maximum(left + kinds, 1) / np.maximum(kinds, 1)), 0.0) if length else np.log10(np.maximum(kinds, 1.0))
            direct = np.log10(np.repeat(total + distinct, distinct) / n)
            values = direct, np.log10(n), np.log10((total + distinct) / distinct), np.log10(np.maximum(left + kinds, 1)), onward
            direct, log_count, escape, left, onward = (v.astype(np.float32) for v in values)
            levels.append(Level(keys, direct, log_count, context, escape, left, onward))
            shorter = keys, n, context, total, distinct
        return cls(levels)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """The code length of each string's last byte in the context of the others; keys are sorted strings of ORDER + 1 bytes."""
        if not self.levels:
            return np.full(len(keys), np.log10(256.0))
        keys = keys & np.uint64((1 << 8 * len(self.levels)) - 1)
        by_key = np.argsort(keys, kind="stable")
        cost = np.empty(len(keys))
        cost[by_key] = self._costs(keys[by_key])
        return cost

    def _costs(self, keys: np.ndarray) -> np.ndarray:
        top = self.levels[-1]
        at, found = top.find(keys)
        cost = top.direct[at].astype(np.float64)
        rest = np.flatnonzero(~found)  # strings that aren't coded yet
        cost[rest] = 0
        excluding = np.zeros(len(rest), bool)  # whether a longer context has been escaped from
        above = np.zeros(len(rest), np.int64)  # that context's place
        keys = keys[rest]
        for length in range(len(self.levels) - 1, -1, -1):
            level = self.levels[length]
            if length < len(self.levels) - 1:
                keys = keys & np.uint64((1 << 8 * (length + 1)) - 1)
                at, found = level.find(keys)
                longer = self.levels[length + 1]
                step = np.where(excluding, np.where(found, longer.left[above] - level.log_count[at], longer.onward[above]), np.where(found, level.direct[at], 0.0))
                cost[rest] += step
                rest, keys, excluding = rest[~found], keys[~found], excluding[~found]
            if not len(rest):
                return cost
            above, known = _find(level.contexts, keys >> np.uint64(8))
            cost[rest] += np.where(known & ~excluding, level.escape[above], 0.0)
            excluding = excluding | known
        cost[rest] += self.levels[0].onward[0]
        return cost


def scores(docs: list[bytes], strings: np.ndarray, costs: np.ndarray) -> list[float]:
    """The log10 probability of each text and its end, from the costs of all their strings (sorted)."""
    out: list[float] = []
    group: list[bytes] = []
    size = 0
    for d in docs:
        group.append(d)
        size += len(d)
        if size >= 1 << 20:
            out += _scores(group, strings, costs)
            group, size = [], 0
    return out + _scores(group, strings, costs)


def _scores(docs: list[bytes], strings: np.ndarray, costs: np.ndarray) -> list[float]:
    if not docs:
        return []
    buffer, starts = _framed(docs)
    first = starts - ORDER
    keys = _keys(buffer, ORDER + 1)
    by_key = np.argsort(keys)
    cost = np.empty(len(keys))
    cost[by_key] = costs[_find(strings, keys[by_key])[0]]
    # What stands between two texts is the next one's frame.
    for k in range(1, ORDER + 1):
        cost[(first - k)[1:]] = 0
    return (-np.add.reduceat(cost, first, dtype=np.float64)).tolist()


def _blocks(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text, trained and block: about BLOCK_BYTES of neighbouring texts, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, total = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = total + np.cumsum(sizes)
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + at // BLOCK_BYTES)], [*batch.schema.names, "block"])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "trained")
    return written(rows.mapInArrow(run, f"doc_id {kind}, text string, trained boolean, block long"), "ppm-texts")


WORD, STRINGS, TEXTS = 0, 1, 2
COUNTS = "kind int, block long, key long, n long, data binary"


def _statistics(batches: Iterator[pa.RecordBatch], buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    """(kind, block, key, n, data): n of a block's words in training texts, its strings by bucket, and the number of training texts."""
    import xxhash

    part = TaskContext.get().partitionId()

    def rows(kind: int, block: int, key: np.ndarray, n: np.ndarray, data: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(key), 100_000):
            cut = slice(k, k + 100_000)
            size = len(key[cut])
            blob = pa.nulls(size, pa.binary()) if data is None else pa.array(data[cut], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, block, np.int64)), pa.array(key[cut]), pa.array(n[cut]), blob], ["kind", "block", "key", "n", "data"])

    def of_block(block: int, words: Counter[bytes], strings: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        packs = [*_bucketed(strings, counts, buckets)]
        yield from rows(STRINGS, block, np.array([b for b, _, _ in packs], np.int64), np.array([n for _, n, _ in packs], np.int64), [d for _, _, d in packs])
        key = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64)
        yield from rows(WORD, block, key, np.fromiter(words.values(), np.int64, len(words)))

    words: Counter[bytes] = Counter()
    strings, counts, now, trained_texts = np.empty(0, np.uint64), np.empty(0, np.int64), None, 0
    for batch in batches:
        docs = texts(batch)
        trained, blocks = batch.column("trained").to_pylist(), batch.column("block").to_pylist()
        trained_texts += sum(trained)
        for b, group in groupby(zip(docs, trained, blocks), lambda x: x[2]):
            if b != now:
                if now is not None:
                    yield from of_block(now, words, strings, counts)
                words, now = Counter(), b
                strings, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
            sides: tuple[list[bytes], list[bytes]] = [], []
            for d, t, _ in group:
                sides[t].append(d)
                found = d.translate(LOWER).split()
                words.update(found if t else dict.fromkeys(found, 0))
            (asked, zero), (more, n) = map(string_counts, sides)
            strings, counts = _summed(np.concatenate((strings, asked, more)), np.concatenate((counts, zero * 0, n)))
    if now is not None:
        yield from of_block(now, words, strings, counts)
    yield from rows(TEXTS, part, np.zeros(1, np.int64), np.array([trained_texts], np.int64))


PACKS = "key long, block long, n long, data binary"


def _merge(table: pa.Table) -> pa.Table:
    """One pack of a bucket's packs."""
    keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for data in table["data"].to_pylist():
        k, c = _unpacked(data)
        keys, n = np.concatenate((keys, k)), np.concatenate((n, c))
        if len(keys) > 4_000_000:
            keys, n = _summed(keys, n)
    keys, n = _summed(keys, n)
    keys, n = keys[n > 0], n[n > 0]
    return pa.table({"key": table["key"][:1].combine_chunks(), "block": table["group"][:1].combine_chunks(), "n": [len(keys)], "data": [_packed(keys, n)]}, schema=pa.schema([("key", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]))


def _merged(packs: DataFrame) -> DataFrame:
    """One pack per bucket: rounds that merge at most WIDTH packs at once."""
    with tidy(packs.sparkSession):
        groups = packs.select("block").distinct().count()
    made = None
    while True:
        groups = max(1, -(-groups // WIDTH))
        packs = written(packs.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("key", "group").applyInArrow(_merge, PACKS), "ppm-strings")
        if made is not None:
            discard(made)
        made = packs
        if groups == 1:
            return packs


def _short(order: int):
    """(key, n) of a bucket's strings, cut to their last order + 1 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                keys, n = _unpacked(data)
                keys, n = _summed(keys & np.uint64((1 << 8 * (order + 1)) - 1), n)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def _order(packs: DataFrame, max_strings: int) -> int:
    """The greatest order of which there are at most max_strings strings, or 1."""
    order = ORDER
    while order > 1 and packs.mapInArrow(frugal(_short(order)), "key long, n long").count() > max_strings:
        order -= 1
    return order


def _costs(packs: DataFrame, asked: DataFrame, order: int | None) -> DataFrame:
    """(block, key, c, data): the packed costs of the strings that blocks ask for; packs and asked have key, block, n and data."""
    with tidy(packs.sparkSession):
        found = packs.mapInArrow(frugal(_short(1)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toPandas()
    shared = packs.sparkSession.sparkContext.broadcast((found["key"].to_numpy(np.uint64), found["n"].to_numpy(np.int64)))
    longest = order or ORDER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, trie = None, None
        for batch in batches:
            for b, block, data, model in zip(*(batch.column(c).to_pylist() for c in ("key", "block", "data", "model"))):
                keys, n = _unpacked(data)
                if b != bucket:
                    known = (keys, n) if model else (keys[:0], n[:0])
                    cut = known[0] & np.uint64((1 << 8 * (longest + 1)) - 1)
                    bucket, trie = b, Trie.of(cut, known[1], shared.value, longest)
                if not model:
                    data = _packed(keys, trie.costs(keys).astype(np.float32).view(np.uint32))
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([b]), pa.array([len(keys)]), pa.array([data], pa.binary())], ["block", "key", "c", "data"])

    columns = "key", "block", "data"
    both = packs.select(*columns, F.lit(True).alias("model")).union(asked.select(*columns, F.lit(False).alias("model")))
    # The model's pack comes first, then a bucket's questions stream past it.
    return both.repartition("key").sortWithinPartitions("key", F.desc("model")).mapInArrow(frugal(run), "block long, key long, c long, data binary")


def scored(docs: DataFrame, trained: Column, max_strings: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score; trained: the condition of training texts.

    Contexts have ORDER bytes; only a caller who gives max_strings asks for the longest ones of which there are no more.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = _blocks(docs.withColumn("trained", F.coalesce(trained, F.lit(False))))
    with tidy(spark):
        size, n_blocks = blocks.agg(F.sum(F.octet_length("text")), F.count_distinct("block")).first()
    size = size or 0
    buckets = min(max(BUCKETS, 1 << max(0, size // BUCKET_BYTES).bit_length()), MOST_BUCKETS)
    found = written(blocks.select("text", "trained", "block").mapInArrow(frugal(lambda x: _statistics(x, buckets)), COUNTS), "ppm-counts")
    strings = found.where(F.col("kind") == STRINGS).select("key", "block", "n", "data")
    packs = _merged(strings)
    costs = written(_costs(packs, strings, None if max_strings is None else _order(packs, max_strings)), "ppm-costs")
    discard(packs)
    asked = written(found.where(F.col("kind") == WORD).select("block", "key", "n"), "ppm-asked")
    with tidy(spark):
        n_texts = int(found.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0)
    discard(found)
    words = written(asked.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0"), "ppm-words")
    with tidy(spark):
        n_words, distinct = words.agg(F.sum("c"), F.count("*")).first()
    total, distinct = int(n_words or 0) + n_texts, distinct + (n_texts > 0)
    answers = written(asked.select("block", "key").join(words, "key").select("block", "key", "c"), "ppm-answers")
    discard(asked, words)
    answers = answers.withColumn("data", F.lit(None).cast("binary")).union(costs)
    logs = np.log10(total + distinct + 1)

    def score(block: pa.Table, counts: pa.Table) -> pa.Table:
        import xxhash

        is_word = pc.is_null(counts["data"])
        of_words, packed = counts.filter(is_word), counts.filter(pc.invert(is_word))["data"].to_pylist()
        by_hash = dict(zip(of_words["key"].to_numpy().view(np.uint64).tolist(), of_words["c"].to_numpy().tolist()))
        both = [_unpacked(data) for data in packed]
        # A block that two tasks have read has asked twice.
        strings, at = np.unique(np.concatenate([k for k, _ in both]), return_index=True) if both else (np.empty(0, np.uint64), np.empty(0, np.int64))
        costs = np.concatenate([c for _, c in both]).astype(np.uint32).view(np.float32)[at] if both else np.empty(0, np.float32)
        known: dict[bytes, int] = {}
        out: list[pa.Table] = []
        for batch in block.to_batches(max_chunksize=500):
            docs = texts(batch)
            n_tokens, n_known, base = [], [], []
            for d in docs:
                found = d.translate(LOWER).split()
                for w in {*found}.difference(known):
                    known[w] = by_hash.get(xxhash.xxh3_64_intdigest(w), 0)
                c = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
                c = np.append(c, n_texts)
                n_tokens.append(len(c))
                n_known.append(int((c > 0).sum()))
                base.append(float(np.log10(c + 1.0).sum() - len(c) * logs))
            values = [n_tokens, n_known, [total] * len(docs), base, scores(docs, strings, costs)]
            kinds = [pa.int64()] * 3 + [pa.float64()] * 2
            out.append(pa.Table.from_arrays([batch.column("doc_id"), batch.column("trained"), *(pa.array(v, k) for v, k in zip(values, kinds))], NAMES))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], pa.schema([("doc_id", block.schema.field("doc_id").type), ("trained", pa.bool_()), *zip(NAMES[2:], [pa.int64()] * 3 + [pa.float64()] * 2)]))

    schema = f"doc_id {kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # So many partitions that a task has a block or two, however many there are.
    parts = min(max(1, 4 * n_blocks), MOST_PARTS)
    met = blocks.repartition(parts, "block").groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block"))
    return met.applyInArrow(score, schema)


NAMES = ["doc_id", "trained", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def held_out_scores(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out and the scores; texts with crc32(doc_id) mod modulus = held_out aren't learned from."""
    found = scored(docs, crc_mod("doc_id", modulus) != held_out)
    return found.select("doc_id", (~F.col("trained")).alias("held_out"), *NAMES[2:])
