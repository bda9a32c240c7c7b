"""TIFF media columns: a decoder for baseline grey or RGB pages, a writer to test it with, and page features.

The decoder walks the image directories, decodes PackBits, LZW or deflate (or plain) strips or tiles, undoes the
horizontal predictor and yields one page per directory. It follows the public TIFF 6.0 specification.

Defined cases: a null text is empty and becomes one row of 64 zero bytes; equal texts give equal files and features;
a file whose directory chain loops, that is cut off, or that declares pages larger than its strips can fill raises
ValueError (in decode_pages: an error row).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, texts

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
WIDTH = 64
#: Bytes of each type of field, by its number.
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
INTEGERS = {1: "B", 3: "H", 4: "I"}


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height, width, samples


def unpack_bits(data: bytes) -> bytes:
    out, k, n = [], 0, len(data)
    while k < n:
        head = data[k]
        if head < 128:
            out.append(data[k + 1 : k + 2 + head])
            k += 2 + head
        elif head > 128:
            out.append(data[k + 1 : k + 2] * (257 - head))
            k += 2
        else:
            k += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, k, n = bytearray(), 0, len(data)
    literal = 0
    while k < n:
        run = 1
        while run < 128 and k + run < n and data[k + run] == data[k]:
            run += 1
        if run >= 3 or k + run == n:
            for a in range(literal, k, 128):
                part = data[a : min(k, a + 128)]
                out += bytes([len(part) - 1]) + part
            out += bytes([(257 - run) & 255 if run > 1 else 0, data[k]])
            k += run
            literal = k
        else:
            k += run
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears the table and 257 ends; a width grows one code early."""
    table: list[bytes] = []
    out: list[bytes] = []
    bits = held = k = 0
    width, last = 9, b""
    while True:
        while held < width:
            if k == len(data):
                return b"".join(out)
            bits, held, k = bits << 8 | data[k], held + 8, k + 1
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            return b"".join(out)
        if code == 256:
            table = [bytes([c]) for c in range(256)] + [b"", b""]
            width, last = 9, b""
            continue
        if not table or code > len(table):
            raise ValueError("LZW: a code that isn't in the table")
        entry = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))


def lzw_encode(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    table: dict[bytes, int] = {bytes([c]): c for c in range(256)}
    put(256, 9)
    width, size, known = 9, 258, b""
    for c in data:
        longer = known + bytes([c])
        if longer in table:
            known = longer
            continue
        put(table[known], width)
        table[longer] = size
        size += 1
        width = max(9, size.bit_length()) if size < 4095 else 12
        if size >= 4094:
            put(256, width)
            table = {bytes([x]): x for x in range(256)}
            width, size = 9, 258
        known = bytes([c])
    if known:
        put(table[known], width)
        size += 1
        width = min(12, max(9, size.bit_length()))
    put(257, width)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


DECODERS = {NONE: lambda x, most: x, LZW: lambda x, most: lzw_decode(x), DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: lambda x, most: unpack_bits(x)}
#: How many bytes a byte of each form can stand for at most.
EXPANSION = {NONE: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """The integer fields of the directory, and the next directory's place."""
    if at + 2 > len(data):
        raise ValueError("a directory lies outside the file")
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for k in range(at + 2, at + 2 + 12 * n, 12):
        tag, kind, count = struct.unpack_from(order + "HHI", data, k)
        size = TYPE_SIZES.get(kind, 0) * count
        place = k + 8 if size <= 4 else struct.unpack_from(order + "I", data, k + 8)[0]
        if kind in INTEGERS:
            fields[tag] = struct.unpack_from(f"{order}{count}{INTEGERS[kind]}", data, place)
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("the chain of directories loops")
        seen.add(at)
        try:
            fields, at = _directory(data, at, order)
            yield _page(data, fields, len(seen) - 1)
        except (struct.error, KeyError, zlib.error, IndexError) as e:
            raise ValueError(f"damaged page {len(seen) - 1}: {e}") from e


def _page(data: bytes, f: dict[int, tuple[int, ...]], index: int) -> Page:
    width, height = f[256][0], f[257][0]
    samples, planar = f.get(277, (1,))[0], f.get(284, (1,))[0]
    compression, predictor = f.get(259, (NONE,))[0], f.get(317, (1,))[0]
    if set(f.get(258, (1,))) != {8} or planar != 1 or compression not in DECODERS or predictor not in (1, 2) or f.get(266, (1,))[0] != 1:
        raise ValueError(f"page {index}: only chunky 8-bit samples in plain, LZW, deflate or PackBits form are read")
    tiled = 322 in f
    w, h = (f[322][0], f[323][0]) if tiled else (width, min(f.get(278, (height,))[0], height))
    places, sizes = (f[324], f[325]) if tiled else (f[273], f[279])
    across, down = -(-width // w), -(-height // h)
    if min(width, height, w, h) < 1 or len(places) < across * down or len(sizes) < across * down:
        raise ValueError(f"page {index}: its strips or tiles don't cover it")
    for place, size in zip(places[: across * down], sizes[: across * down]):
        if place + size > len(data):
            raise ValueError(f"page {index}: cut off")
    # Before memory is taken for the page: its strips or tiles must be able to fill it.
    if samples < 1 or any(min(h, height - k // across * h) * w * samples > size * EXPANSION[compression] for k, size in enumerate(sizes[: across * down])):
        raise ValueError(f"page {index}: a strip or tile is too short")
    out = np.empty((height, width, samples), np.uint8)
    decode = DECODERS[compression]
    for k in range(across * down):
        x, y = k % across * w, k // across * h
        rows = h if tiled else min(h, height - y)
        raw = decode(data[places[k] : places[k] + sizes[k]], rows * w * samples)
        if len(raw) < rows * w * samples:
            raise ValueError(f"page {index}: a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, rows * w * samples).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return Page(index, width, height, samples, compression, predictor, out)


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: int = 0, order: str = "<") -> bytes:
    """A file with a page per image (height, width, samples), in strips of so many rows or, if tile, square tiles."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    for image in images:
        height, width, samples = image.shape
        w, h = (tile, tile) if tile else (width, min(rows, height))
        blocks = []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                blocks.append(ENCODERS[compression](np.ascontiguousarray(block).tobytes()))
        places = []
        for b in blocks:
            places.append(len(out))
            out += b + bytes(len(b) % 2)
        fields = [(256, [width]), (257, [height]), (258, [8] * samples), (259, [compression]), (262, [1 if samples == 1 else 2]), (277, [samples]), (317, [predictor])]
        fields += [(322, [w]), (323, [h]), (324, places), (325, [*map(len, blocks)])] if tile else [(273, places), (278, [h]), (279, [*map(len, blocks)])]
        entries = b""
        for tag, values in sorted(fields):
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                place = len(out)
                out += body
                body = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + body
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def feature(page: Page) -> str:
    """A page's mean, spread and entropy, and the hash of its means over an 8 x 8 grid against the mean."""
    flat = page.pixels.reshape(-1)
    counts = np.bincount(flat, minlength=256)
    n, levels = len(flat), np.arange(256)
    mean = float(counts @ levels) / n
    spread = (max(0.0, float(counts @ levels**2) / n - mean * mean)) ** 0.5
    p = counts[counts > 0] / n
    rows = np.add.reduceat(page.pixels.sum((2,), dtype=np.int64), np.unique(np.arange(8) * page.height // 8), axis=0)
    grid = np.add.reduceat(rows, np.unique(np.arange(8) * page.width // 8), axis=1)
    bits = np.packbits(grid.reshape(-1) * grid.size > grid.sum())
    return f"{page.height}x{page.width} mean={mean:.3f} std={spread:.3f} entropy={abs(float(-(p * np.log2(p)).sum())):.3f} grid={bits.tobytes().hex()}"


def decode_pages(files: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """A row per page: id, page, width, height, samples, compression, predictor, pixels, feature; error names what can't be read."""
    kind = files.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, feature string, error string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column("media").to_pylist()):
                rows = []
                try:
                    for p in pages(data or b""):
                        rows.append((p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.pixels.tobytes(), feature(p), None))
                except ValueError as e:
                    rows.append((len(rows), *[None] * 7, str(e)))
                ids = batch.column("id").take(pa.array([k] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], names)

    return files.select(F.col(id_column).alias("id"), F.col(media_column).cast("binary").alias("media")).mapInArrow(run, schema)


def stored(docs: DataFrame, compression: int = DEFLATE, predictor: int = 1, page_rows: int = 65_536) -> DataFrame:
    """doc_id, n_bytes and media: each text, padded by zeros, as a TIFF of 64 columns and pages of at most page_rows rows."""
    session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in texts(batch):
                sizes.append(len(text))
                payload = text.ljust(max(WIDTH, -(-len(text) // WIDTH) * WIDTH), b"\0")
                rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
                media.append(encode([rows[k : k + page_rows] for k in range(0, len(rows), page_rows)], compression, predictor))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def digest(files: DataFrame) -> DataFrame:
    """Lengths and hashes of the stored files and of the payload that is read back from them, and the pages' features."""
    kind = files.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")][2:]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("media").to_pylist():
                found = list(pages(data))
                payload = b"".join(p.pixels.tobytes() for p in found)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), "; ".join(map(feature, found))))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, t) for x, t in zip(columns, kinds))], ["doc_id", "n_bytes", *names])

    return files.mapInArrow(run, schema)
