"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lowered. The automaton is over word
numbers; a document's words are streamed through it and the longest match that ends at each word is kept. A
match of `window` words or more, or a whole item of fewer words, is an occurrence, and its words are hit.
Runs of known words shorter than the shortest window can't hold one and are skipped without stepping.

The benchmark is cut into shards of about SHARD_BYTES of text by a hash of the item. One shard is at the driver and at
the workers at a time: each pass over the documents writes the hits of one shard by the text's digest, its broadcast is
destroyed, and the next shard is read; at the end the hits meet the documents. A benchmark of one shard takes one pass and
no join. An item longer than SHARD_BYTES is a shard that is as long.

Defined cases: null or empty texts have no words, aren't contaminated, and as items are ignored; repeated items
count once by item_id; a null item_id is named "null"; without items nothing is hit. Rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, session, texts, tidy, written

SHARD_BYTES = 1_000_000
#: A-Z lowered; every byte that isn't part of a word becomes a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class ItemAutomaton:
    """The suffix automaton of all items, with the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = 13):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        prefixes: list[tuple[int, str, int]] = []
        whole: list[tuple[int, str, int]] = []
        self.shortest = window
        for name, text in items:
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not numbers:
                continue
            state = 0
            for k, c in enumerate(numbers):
                state = self._extend(state, c)
                if k + 1 >= window:
                    prefixes.append((state, name, k + 1))
            if len(numbers) < window:
                whole.append((state, name, len(numbers)))
                self.shortest = min(self.shortest, len(numbers))
        self._items(prefixes, whole)

    def _extend(self, last: int, c: int) -> int:
        """Append c to the item whose state is last; a state that already stands for it is used again."""
        following, link, length = self.next, self.link, self.length
        q = following[last].get(c)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p != -1:
            q = following[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _items(self, prefixes: list[tuple[int, str, int]], whole: list[tuple[int, str, int]]) -> None:
        """at_window: the suffix state that holds the last `window` words; found: items of such a state; short: whole items that end in a state."""
        n, order = len(self.next), sorted(range(1, len(self.next)), key=self.length.__getitem__)
        self.at_window = [-1] * n
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        ends: dict[int, list[tuple[int, str]]] = {}
        for state, name, size in whole:
            ends.setdefault(state, []).append((size, name))
        for s in order:
            up = self.link[s]
            self.at_window[s] = self.at_window[up] if self.length[up] >= self.window else s if self.length[s] >= self.window else -1
            self.short[s] = self.short[up] + tuple(ends.get(s, ()))
        self.found: dict[int, set[str]] = {}
        for state, name, _ in prefixes:
            self.found.setdefault(self.at_window[state], set()).add(name)

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit ranges of words (from, to), apart and in order, and the items with windows that occur."""
        names: set[str] = set()
        hits: list[tuple[int, int]] = []
        if not self.vocabulary or len(words) < self.shortest:
            return hits, names
        ids = np.fromiter(map(self._number, words), np.int64, len(words))
        for start, end in _runs(ids >= 0):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, hits, names)
        return _merged(hits), names

    def _number(self, word: bytes) -> int:
        return self.vocabulary.get(word, -1)

    def _stream(self, ids: list[int], offset: int, hits: list[tuple[int, int]], names: set[str]) -> None:
        following, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for k, c in enumerate(ids, offset + 1):
            while state and c not in following[state]:
                state = link[state]
                matched = length[state]
            if (to := following[state].get(c)) is not None:
                state, matched = to, matched + 1
            if matched >= window:
                hits.append((k - window, k))
                names |= self.found.get(self.at_window[state], set())
            for size, name in self.short[state]:
                if size <= matched:
                    hits.append((k - size, k))
                    names.add(name)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


Items = list[tuple[str, bytes]]


def _shards(benchmark: DataFrame, shard_bytes: int) -> tuple[int, Iterator[Items]]:
    """The number of shards, and the items of each, read when it is its turn."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with tidy(benchmark.sparkSession):
        total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("name", "text"), F.lit(n))
    return n, ([(r.name, r.text.encode()) for r in items.where(shard == k).collect()] for k in range(n))


FOUND = "hits array<int>, items array<string>"


def _arrays(counts: list[int], hits: list[list[int]], names: list[list[str]]) -> list[pa.Array]:
    return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text, n_words, hits (flat array of from, to in words) and items (names), a row per row of docs."""
    spark = session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    n_shards, shards = _shards(benchmark, shard_bytes)
    schema = f"doc_id {kind}, text string, n_words long, {FOUND}"
    columns = ["doc_id", "text", "n_words", "hits", "items"]
    if n_shards == 1:
        shared = spark.sparkContext.broadcast(next(shards))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ItemAutomaton(shared.value, window)
            for batch in batches:
                counts, hits, names = [], [], []
                for text in texts(batch):  # the words of one text at a time
                    words = words_of(text)
                    found, items = automaton.match(words)
                    counts.append(len(words))
                    hits.append([x for r in found for x in r])
                    names.append(sorted(items))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *_arrays(counts, hits, names)], columns)

        return rows.mapInArrow(frugal(run), schema)
    parts = []
    for items in shards:
        shared = spark.sparkContext.broadcast(items)
        parts.append(written(_searched(rows, shared, window), "decontamination-hits"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    # A text has at most a row a shard.
    merged = written(every.groupBy("d").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items")), "decontamination-merged")
    discard(*parts)
    met = rows.withColumn("d", _digest()).join(merged, "d", "left").select("doc_id", "text", "hits", "items")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [[x for r in _merged([*zip(h[::2], h[1::2])]) for x in r] if h else [] for h in batch.column("hits").to_pylist()]
            names = [sorted(set(x or ())) for x in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *_arrays([len(words_of(t)) for t in texts(batch)], hits, names)], columns)

    return met.mapInArrow(count, schema)


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _searched(rows: DataFrame, shared: Broadcast, window: int) -> DataFrame:
    """(d, hits, items) of the texts that the shard's items hit, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ItemAutomaton(shared.value, window)
        for batch in batches:
            found = [(d, *automaton.match(words_of(t))) for d, t in zip(batch.column("d").to_pylist(), texts(batch))]
            found = [(d, [x for r in hits for x in r], sorted(names)) for d, hits, names in found if hits]
            d, hits, names = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), *_arrays([], list(hits), list(names))[1:]], ["d", "hits", "items"])

    return rows.select(_digest().alias("d"), "text").mapInArrow(frugal(run), f"d binary, {FOUND}").dropDuplicates(["d"])


def cut_words(text: bytes, hits: list[int]) -> bytes:
    """The text without the hit words and what stands between them."""
    flags = np.frombuffer(text.translate(WORDS), np.uint8) != 32
    at = np.array(_runs(flags)).reshape(-1, 2)
    out, last = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(text[last : at[a, 0]])
        last = at[b - 1, 1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_coverage: float = 0.5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without hit spans; rows whose hit words reach max_coverage of all words go. n_chars, if there, is counted anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select(F.struct(*(docs[c] for c in ("doc_id", *rest))).alias("doc_id"), "text")
    found = contamination(packed, benchmark, window, shard_bytes)
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, keep = batch.column("text").to_pylist(), []
            for k, (n, hits) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("hits").to_pylist())):
                keep.append(not hits or sum(hits[1::2]) - sum(hits[::2]) < max_coverage * n)
                if hits and keep[-1]:
                    text[k] = cut_words(text[k].encode(), hits).decode()
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(mask), pa.array(text, pa.string()).filter(mask)], ["doc_id", "text"])

    out = found.mapInArrow(run, f"doc_id {kind}, text string")
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return out.select(*(F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col("doc_id")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated (20 * n_hit >= n_words > 0 hits)."""
    found = contamination(docs, benchmark, window)
    signed = F.transform("hits", lambda x, k: F.when(k % 2 == 1, x).otherwise(-x).cast("long"))
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
