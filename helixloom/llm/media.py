"""Media columns: Netpbm and BMP images as numpy arrays, area-resized NPY tiles, difference hashes.

Images are resized by integral images: the integral is interpolated at the fractional
edges of each output cell, in whole numbers, so means are exact. A sample above the stated maximum is that maximum. Only those of its
rows are worked out that have an edge in them, so a tall image costs no more memory than itself.

Batches are worked through in slices of bounded size, or of one row. Nulls and odd input:
null or undecodable content gives null features and a message in
``error``; nothing raises. Repeated rows give repeated results, an empty table gives an
empty one, and other columns of the input pass by unread.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._text import chunks

#: Samples in a row of a stored payload.
ROW = 64
TILE = 32


def encode_pgm(samples: np.ndarray) -> bytes:
    """A binary greymap of 8-bit samples."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette, rows from the bottom up."""
    height, width = samples.shape
    padded = np.zeros((height, -(-width // 4) * 4), np.uint8)
    padded[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = b"BM" + struct.pack("<IHHI", start + padded.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, padded.size, 2835, 2835, 256, 0) + palette.tobytes() + padded.tobytes()


def decode_netpbm(content: bytes) -> np.ndarray:
    """P1 to P6: height x width, or height x width x 3."""
    kind, at, fields = content[:2], 2, []
    while len(fields) < (2 if kind in (b"P1", b"P4") else 3):
        found = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d{1,9})(?!\d)").match(content, at)
        if not found:
            raise ValueError("broken Netpbm header")
        fields.append(int(found[1]))
        at = found.end()
    width, height = fields[:2]
    depth = 3 if kind in (b"P3", b"P6") else 1
    need = width * height * depth
    if not need or len(fields) > 2 and not 0 < fields[2] < 1 << 16:
        raise ValueError("empty Netpbm image or samples out of range")
    if need > 8 * len(content):
        raise ValueError("truncated Netpbm image")
    if kind == b"P1":
        flat = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", content[at:]), np.uint8)[:need]
        flat = np.where(flat == ord("1"), 0, 255).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        listed = re.sub(rb"#[^\n]*", b"", content[at:]).split()[:need]
        if any(len(x) > 9 or not x.isdigit() for x in listed):
            raise ValueError("broken Netpbm samples")
        flat = np.minimum(np.array(listed, dtype=np.int64), fields[2])
        flat = (flat * 255 // fields[2]).astype(np.uint8)
    elif kind == b"P4":
        rows = np.frombuffer(content, np.uint8, height * (-(-width // 8)), at + 1).reshape(height, -1)
        flat = np.where(np.unpackbits(rows, axis=1)[:, :width], 0, 255).astype(np.uint8).ravel()
    elif kind in (b"P5", b"P6"):
        if fields[2] > 255:
            wide = np.frombuffer(content, ">u2", need, at + 1).astype(np.int64)
            flat = (np.minimum(wide, fields[2]) * 255 // fields[2]).astype(np.uint8)
        else:
            flat = np.frombuffer(content, np.uint8, need, at + 1)
            if fields[2] < 255:
                flat = (np.minimum(flat, fields[2]).astype(np.int64) * 255 // fields[2]).astype(np.uint8)
    else:
        raise ValueError("not a Netpbm image")
    if flat.size < need:
        raise ValueError("truncated Netpbm image")
    return flat.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(content: bytes) -> np.ndarray:
    """Uncompressed BMP of 8, 24 or 32 bits a pixel: height x width, or height x width x 3."""
    start, = struct.unpack_from("<I", content, 10)
    size, width, height, _, bits, packed = struct.unpack_from("<IiiHHI", content, 14)
    if packed or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    stride = -(-width * bits // 32) * 4
    if start + stride * abs(height) > len(content):
        raise ValueError("truncated BMP")
    rows = np.frombuffer(content, np.uint8, stride * abs(height), start).reshape(abs(height), stride)
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours, = struct.unpack_from("<I", content, 46)
        if 14 + size + 4 * (colours or 256) > len(content):
            raise ValueError("truncated BMP palette")
        table = np.frombuffer(content, np.uint8, (colours or 256) * 4, 14 + size).reshape(-1, 4)
        shade = table[rows[:, :width]]
        grey = (table[:, 0] == table[:, 1]).all() and (table[:, 1] == table[:, 2]).all()
        return shade[..., 0] if grey else shade[..., 2::-1]
    return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[..., 2::-1]


def decode(content: bytes) -> np.ndarray:
    """A Netpbm or BMP image."""
    return decode_bmp(content) if content[:2] == b"BM" else decode_netpbm(content)


def area_sums(image: np.ndarray, height: int, width: int) -> tuple[np.ndarray, int]:
    """For every output cell the sum of what its area covers, and the area to divide it by, in whole numbers: exact."""
    rows, cols = image.shape[:2]
    channels = image.shape[2] if image.ndim == 3 else 1
    grey = image.sum(axis=2, dtype=np.int64) if image.ndim == 3 else image
    at = np.arange(height + 1, dtype=np.int64) * rows
    low, part = np.minimum(at // height, rows - 1), at - np.minimum(at // height, rows - 1) * height
    cuts = np.unique(np.concatenate([low, low + 1]))  # from 0 to rows
    total = np.zeros((len(cuts), cols + 1), np.int64)
    np.cumsum(np.add.reduceat(grey, cuts[:-1], axis=0, dtype=np.int64), axis=0, out=total[1:, 1:])
    np.cumsum(total, axis=1, out=total)
    down = total[np.searchsorted(cuts, low)] * (height - part)[:, None] + total[np.searchsorted(cuts, low + 1)] * part[:, None]
    at = np.arange(width + 1, dtype=np.int64) * cols
    low, part = np.minimum(at // width, cols - 1), at - np.minimum(at // width, cols - 1) * width
    cut = down[:, low] * (width - part) + down[:, low + 1] * part
    return np.diff(np.diff(cut, axis=0), axis=1), rows * cols * channels


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each output cell's area, by an integral image."""
    sums, area = area_sums(image, height, width)
    return sums / area


def difference_hash(image: np.ndarray) -> str:
    """64 bits: whether each cell of a 8 x 9 grid is darker than its right neighbour."""
    grid, _ = area_sums(image, 8, 9)
    return np.packbits((grid[:, :-1] < grid[:, 1:]).ravel()).tobytes().hex()


def npy_tile(image: np.ndarray, edge: int = TILE) -> bytes:
    """The area-resized image as an NPY file of 8-bit samples, halves rounded up."""
    out = io.BytesIO()
    sums, area = area_sums(image, edge, edge)
    np.save(out, np.ascontiguousarray((2 * sums + area) // (2 * area), np.uint8), allow_pickle=False)
    return out.getvalue()


def payload(text: np.ndarray) -> bytes:
    """The bytes, and bytes 0 up to a positive multiple of 64."""
    return text.tobytes() + bytes(max(ROW, -(-len(text) // ROW) * ROW) - len(text))


def _store(batches: Iterator[pa.RecordBatch], form: str) -> Iterator[pa.RecordBatch]:
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
    for batch in batches:
        for part, raw, offsets in chunks(batch):
            media = [encode(np.frombuffer(payload(raw[offsets[i] : offsets[i + 1]]), np.uint8).reshape(-1, ROW)) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """doc_id, n_bytes and media: each text (null: empty) as the samples of a "pgm" or "bmp" image."""
    return _texts(docs).mapInArrow(lambda batches: _store(batches, form), "doc_id long, n_bytes long, media binary")


FEATURES = "width int, height int, payload binary, tile binary, difference_hash string, error string"
_NAMES = [f.split()[0] for f in FEATURES.split(", ")]


def features(content: bytes | None) -> tuple:
    """FEATURES of one stored image."""
    if content is None:
        return None, None, None, None, None, None
    try:
        image = decode(content)
        return image.shape[1], image.shape[0], image.tobytes(), npy_tile(image), difference_hash(image), None
    except (ValueError, struct.error, IndexError, OverflowError) as e:
        return None, None, None, None, None, str(e)


def _featured(batches: Iterator[pa.RecordBatch], media: str) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
    for batch in batches:
        for part, _, _ in chunks(batch, media):
            rows = [features(x.as_py()) for x in part.column(media)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, *_NAMES])


def media_features(stored: DataFrame, media: str = "media") -> DataFrame:
    """The input's columns and, decoded from ``media``: width, height, payload, tile, difference_hash, error."""
    kept = stored.select([c for c in stored.columns if c.lower() not in _NAMES])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [FEATURES])
    return kept.mapInArrow(lambda batches: _featured(batches, media), schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda column: pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in column], pa.string())
    size = lambda column: pa.array([None if x is None else len(x) for x in column], pa.int64())
    for batch in batches:
        for part, _, _ in chunks(batch, "media"):
            pay, media, tile = (part.column(c).to_pylist() for c in ("payload", "media", "tile"))
            crc = pa.array([None if x is None else zlib.crc32(x[-ROW:]) for x in pay], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), size(pay), sha(pay), crc, size(media), sha(media), part.column("difference_hash"), sha(tile)], [f.split()[0] for f in DIGEST.split(", ")])


def digest(featured: DataFrame) -> DataFrame:
    """Sizes and digests of payload and stored form, read back from the media column; null where it couldn't be."""
    return featured.select("doc_id", "n_bytes", "media", "payload", "tile", "difference_hash").mapInArrow(_digested, DIGEST)


def digest_texts(docs: DataFrame, form: str = "pgm") -> DataFrame:
    """digest(media_features(store_texts(docs, form))) with one trip of each text to Python instead of three."""
    return _texts(docs).mapInArrow(lambda batches: _digested(_featured(_store(batches, form), "media")), DIGEST)
