"""Packing: concatenate all documents' tokens and cut them at fixed windows.

Pass one tokenizes each partition and writes, with the tokens, every document's offset within its partition.
A prefix sum over the partitions' totals (a row a partition) gives each partition's global offset. Pass two
knows each document's global place and cuts it at multiples of the window: a piece is a boundary record
(document, start, length, sequence, offset). Only the last sequence is short, so there is next to no padding.

Defined cases: a null or empty text is its end token alone; repeated rows are packed as often as they occur; an
empty table gives no pieces. The order is that of the written table: partitions, then rows.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, session, written

#: An encoder keeps the ids of this many words that were met lately, twice; what is returned doesn't depend on it.
CACHE_WORDS = 200_000
#: Texts of about so many bytes are encoded at once.
GATHERED_BYTES = 6 << 20
#: Marks that are a token group of their own behind an ASCII letter or digit.
MARKS = b".,;:!?"
_MARKED = frozenset(bytes([c]) for c in MARKS)
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")
#: Letters before this one are composed, and lower to one letter.
PLAIN_LETTERS = "\u0130"
#: Bytes that aren't printable in Latin-1 stand for letters from U+0100 on in byte-level vocabularies.
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate([*range(33), *range(127, 161), 173])}


def _pack(tokens: list) -> bytes:
    return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])


def _letters(word: bytes) -> str | None:
    """The word as the vocabulary's model reads it, if it is a single run of letters whose normal form is plain to see."""
    text = word.decode()
    if not text.isalpha() or max(text) >= PLAIN_LETTERS:
        return None
    return text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)


#: How a vocabulary's file says that it lowers case, drops white space and splits letters from marks.
LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_words(config: dict) -> bool:
    """Whether a text's ids are those of its words, one after the other; the file of the vocabulary tells."""
    added = [t["content"] for t in config.get("added_tokens") or []]
    plain = config.get("truncation") is None and config.get("padding") is None and config["model"].get("dropout") is None
    return plain and config.get("normalizer") == LOWERS and config.get("pre_tokenizer") == SPLITS and not any(a.isalnum() or a.split() != [a] or a[-1] in MARKS.decode() for a in added)


@cache
def _splits_words(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        return splits_words(json.load(f))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """The tokenizer's ids of a text, word by word where the vocabulary allows it.

    If its splitting lowers case, drops white space and never joins across it, a text's ids are those of its
    space-separated words, low, and those of a word that ends in marks are the word's and the marks'. A word that was met
    before is looked up; one that wasn't met for long is forgotten. With any other vocabulary whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = _splits_words(path)
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _bases(self, bases: set[bytes]) -> dict[bytes, bytes]:
        if len(self.recent) > CACHE_WORDS:
            self.older, self.recent = self.recent, {}
        recent = self.recent
        new = bases.difference(recent)
        if kept := new & self.older.keys():
            recent.update((b, self.older[b]) for b in kept)
            new -= kept
        rest, tokenize, pack = [], self.tokenizer.model.tokenize, _pack
        for w in new:
            if w.isalpha():
                recent[w] = pack(tokenize(w.decode()))
            elif (letters := _letters(w)) is not None:
                recent[w] = pack(tokenize(letters))
            else:
                rest.append(w)
        for k in range(0, len(rest), 4000):
            part = rest[k : k + 4000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            recent.update((w, struct.pack(f"<{len(ids)}I", *ids)) for w, ids in zip(part, (e.ids for e in found)))
        return recent

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each distinct word, its ASCII letters low."""
        bases, marks = list(words), {}
        for k in [k for k, low in enumerate(words) if low[-1:] in _MARKED]:
            base = words[k].rstrip(MARKS)
            if base and base[-1] in _ALNUM:
                bases[k], marks[k] = base, words[k][len(base) :]
        ids = self._bases({*bases, *marks.values()})
        out = [*map(ids.__getitem__, bases)]
        for k, m in marks.items():
            out[k] += ids[m]
        return out

    def _encode_whole(self, column: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        whole = pc.fill_null(column.cast(pa.large_string()), "").to_pylist()
        found = [np.array([*e.ids, end_id], "<u4") for k in range(0, len(whole), 64) for e in self.tokenizer.encode_batch_fast(whole[k : k + 64], add_special_tokens=False)]
        return pa.array([ids.tobytes() for ids in found], pa.large_binary()), np.array([len(ids) for ids in found], np.int64)

    def encode(self, column: pa.Array, end_id: int) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text with end_id behind them, as bytes, and their numbers.

        Words are split and told apart by Arrow; Python sees each distinct word of the batch once.
        """
        if not self.by_words:
            return self._encode_whole(column, end_id)
        if column.offset:  # lowering takes no slices
            column = pa.concat_arrays([column, column[:0]])
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
        words = lists.flatten().dictionary_encode()
        texts_ids = [*self.ids_of(words.dictionary.cast(pa.large_binary()).to_pylist()), struct.pack("<I", end_id)]
        sizes = np.array([len(x) // 4 for x in texts_ids], np.int64)
        pool, begins = np.frombuffer(b"".join(texts_ids), "<u4"), np.cumsum(sizes) - sizes
        ends = lists.offsets.to_numpy().astype(np.int64)
        index = words.indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
        index = np.insert(index, ends[1:] - ends[0], len(sizes) - 1)
        stops = ends[1:] - ends[0] + np.arange(1, len(ends))
        total = np.concatenate(([0], np.cumsum(sizes[index])))
        offsets = np.concatenate(([0], total[stops]))
        out = np.empty(offsets[-1], "<u4")
        for k in range(0, len(index), 1 << 19):  # so many words at a time, for memory
            part = index[k : k + (1 << 19)]
            n = sizes[part]
            at = total[k]
            shift = np.repeat(begins[part] - (total[k : k + len(part)] - at), n)
            out[at : at + len(shift)] = pool[shift + np.arange(len(shift))]
        data = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(offsets * 4), pa.py_buffer(out)])
        return data, np.diff(offsets)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The ids and texts of some batches at a time: the more texts at once, the fewer words are looked at again."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= GATHERED_BYTES:
            yield _columns(held)
            held = []
    if held:
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return tuple(pa.concat_arrays(table[c].chunks) if table.num_rows else held[0].column(c) for c in ("doc_id", "text"))


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """doc_id, part, place (offset in the partition), n and ids (little-endian 32-bit), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(vocabulary)
        part, place = TaskContext.get().partitionId(), 0
        for doc_ids, column in _gathered(batches):
            ids, n = encoder.encode(column, end_id)
            places = place + np.cumsum(n) - n
            place += int(n.sum())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.full(len(n), part, np.int32)), pa.array(places), pa.array(n), ids.cast(pa.binary())], ["doc_id", "part", "place", "n", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(frugal(run), f"doc_id {kind}, part int, place long, n long, ids binary"), "packing-tokens")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = 4096, end_id: int = 2) -> DataFrame:
    """A row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    session(docs.sparkSession)
    rows = tokenized(docs, vocabulary or default_vocabulary(), end_id)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # A row a partition of the input: small, whatever the number of documents.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))
    placed = rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = batch.column("at").to_numpy(), batch.column("n").to_numpy()
            first, last = at // window, (at + n - 1) // window
            row = np.repeat(np.arange(len(at)), last - first + 1)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[row]
            begin, stop = np.maximum(sequence * window, at[row]), np.minimum((sequence + 1) * window, (at + n)[row])
            start = begin - at[row]
            ids = batch.column("ids").to_pylist()
            cut = [ids[r][4 * a : 4 * b] for r, a, b in zip(row.tolist(), start.tolist(), (stop - at[row]).tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array(cut, pa.binary()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = 4096, pad_id: int = 0) -> DataFrame:
    """A row per sequence: sequence_id, n_tokens, doc_ids, offsets and ids, padded to the window or, the last, to a power of two."""
    packed = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    size = F.least(F.lit(window).cast("double"), F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n_tokens"), F.lit(1))))))
    ids = F.aggregate("p", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (size - F.col("n_tokens")).cast("int")))
    return packed.select("sequence_id", n.alias("n_tokens"), "p").select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"), F.concat(ids, pad).alias("ids"))


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


