"""Token ids of documents as shard files, each a compressed wavelet matrix.

Documents are dealt by ranges of doc_id and written in its ascending order (null last; rows of one doc_id by
a hash of their text, equal rows in any order). A shard holds about SHARD_TOKENS ids of whole
documents, more only if one document has more. Its ids are bit-planes, from the highest
bit down: behind every plane the ids whose bit is 0 go before those whose bit is 1, each in
their order. Planes are cut in blocks, compressed one by one, with the number of ones before each, so
an id at a place, how often an id occurs before a place, and the place of its k-th
occurrence each read a block or a few of every plane, not the file.

A null text has no ids but the end id, as has an empty one. An empty table gives no files and no rows; other
columns are ignored. doc_id is an integer.
"""

from __future__ import annotations

import itertools
import json
import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixloom.llm._text import chunks, column_bytes
from helixloom.llm.encoders import SLICE_BYTES, SLICE_ROWS, Words, forget, gather, interleave, once, strings
from helixloom.sources import blobs

SHARD_TOKENS = 1 << 20
BLOCK_BYTES = 4096
END = 1
MAGIC = b"WMTX0001"
#: Words of letters that go to the tokenizer as one text, and the letters up to which they do, as the library holds many bytes for each.
JOINED_WORDS, JOINED_LETTERS = 1024, 64
_TRAILING = string.punctuation


class Encoder:
    """Ids of texts with a tokenizer that drops white space and whose words end at it, each text followed by ``end``.

    A word is looked up without capitals A-Z and without ASCII punctuation at its end, as
    the tokenizer lowers letters and cuts between letters or numbers and punctuation; behind which letters it
    does is asked of the library, as some end in a mark once they are lowered or composed. Texts that may
    hold a special token go to the library whole.
    """

    def __init__(self, path: str, end: int = END) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        if suffix:
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.cut_behind: dict[str, bool] = {"": False}
        self.words = Words(self._ids, joined=self._joined)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn and their bounds, most words of letters from one text.

        Each such word has at least one id that ends a word, so if a text has as many of these as words, each
        ends one word. If not, as where a letter is composed of a letter and a mark, its words go one by one.
        """
        letters = np.fromiter((len(w) <= JOINED_LETTERS and w.isalpha() for w in words), bool, len(words)) & bool(self.last.any())
        plain = list(itertools.compress(words, letters))
        groups = [plain[i : i + JOINED_WORDS] for i in range(0, len(plain), JOINED_WORDS)]
        flat, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            ids = np.array(found, np.int32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(group) and ends[-1] == len(ids) - 1:
                n = np.diff(ends, prepend=-1)
            else:
                each = self._ids(group)
                ids, n = np.array([i for one in each for i in one], np.int32), np.array([len(one) for one in each])
            flat.append(ids)
            lengths.append(n)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        return interleave(letters, (np.concatenate(flat), bounds), self._ids(list(itertools.compress(words, ~letters))))

    def _cut(self, letters: pa.Array) -> pa.Array:
        """Whether the tokenizer cuts between each letter and punctuation behind it."""
        held = letters.dictionary_encode()
        unique = strings(held.dictionary)
        new = [c for c in unique if c not in self.cut_behind]
        alone = self._ids([".", *new])
        for c, ids, both in zip(new, alone[1:], self._ids([c + "." for c in new]), strict=True):
            self.cut_behind[c] = both == ids + alone[0]
        return pa.array(np.array([self.cut_behind[c] for c in unique], bool)).take(held.indices)

    def _by_word(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn and each word's bounds, from its letters and its punctuation."""
        held = words.dictionary_encode()
        low = pc.if_else(pc.string_is_ascii(held.dictionary), pc.ascii_lower(held.dictionary), held.dictionary)
        core = pc.utf8_rtrim(low, _TRAILING)
        cut = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(low)), self._cut(pc.utf8_slice_codeunits(core, -1)))
        core = pc.if_else(cut, core, low)
        raw, at = column_bytes(low.filter(cut))
        before = pc.binary_length(core.filter(cut)).to_numpy(zero_copy_only=False)
        tails, ends = gather(raw, at[:-1] + before, np.diff(at) - before)
        tails = pa.StringArray.from_buffers(len(before), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(tails))
        both = self.words.places(pa.concat_arrays([core, tails, pa.array([""])]))
        behind = np.full(len(core), both[-1])
        behind[np.flatnonzero(cut.to_numpy(zero_copy_only=False))] = both[len(core) : -1]
        parts = np.stack([both[: len(core)], behind], axis=1)[held.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros((0, 2), np.int64)
        flat, bounds = self.words.gathered(parts.ravel())
        return flat, bounds[::2]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id, and the bounds of each text's."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False).astype(bool)
        split = pc.ascii_split_whitespace(texts.filter(pa.array(~special)))
        words = split.flatten()
        filled = pc.not_equal(words, "")
        flat, bounds = self._by_word(words.filter(filled))
        kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))]).astype(np.int64)
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat, bounds = interleave(~special, (flat, bounds[kept[rows]]), self._ids(texts.filter(pa.array(special)).to_pylist()))
        n = np.diff(bounds)
        out = np.full(len(flat) + len(n), self.end, np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
        return out, bounds + np.arange(len(n) + 1)


def planes(ids: np.ndarray, width: int) -> tuple[list[np.ndarray], list[int]]:
    """The packed bit-planes of the ids, from the highest bit down, and how many zeros each has."""
    seq, out, zeros = ids.astype(np.uint16 if width <= 16 else np.uint32), [], []
    for b in range(width - 1, -1, -1):
        on = (seq & seq.dtype.type(1 << b)) != 0
        out.append(np.packbits(on, bitorder="little"))
        low = seq.take(np.flatnonzero(~on))
        zeros.append(len(low))
        seq = np.concatenate([low, seq.take(np.flatnonzero(on))])
    return out, zeros


def to_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, first: int, width: int) -> bytes:
    """A shard: documents, their lengths and ids; ``first`` ids of its folder come before."""
    press = zstandard.ZstdCompressor(level=1)
    packed, zeros = planes(ids, width)
    blocks, ones = [], []
    for plane in packed:
        starts = range(0, len(plane), BLOCK_BYTES)
        counts = [int(np.bitwise_count(plane[i : i + BLOCK_BYTES]).sum()) for i in starts]
        ones.append(np.concatenate([[0], np.cumsum(counts)])[: len(counts)])
        blocks += [press.compress(plane[i : i + BLOCK_BYTES].tobytes()) for i in starts]
    tables = {
        "documents": np.array([0 if d is None else d for d in doc_ids], "<i8"), "known": np.array([d is not None for d in doc_ids], np.uint8), "lengths": np.array(lengths, "<i8"),
        "ones": np.concatenate(ones).astype("<i8"), "ends": np.cumsum([len(b) for b in blocks]).astype("<i8"),
    }
    held = {k: press.compress(v.tobytes()) for k, v in tables.items()}
    head = json.dumps({"n": len(ids), "first": first, "width": width, "block": BLOCK_BYTES, "zeros": zeros, "tables": {k: len(v) for k, v in held.items()}}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *held.values(), *blocks])


class Shard:
    """Reads a shard file; only the blocks that a question needs are decompressed."""

    def __init__(self, content: bytes) -> None:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        at = len(MAGIC) + 4
        size, = struct.unpack_from("<I", content, len(MAGIC))
        self.head = json.loads(content[at : at + size])
        at += size
        self._unpress = zstandard.ZstdDecompressor()
        tables = {}
        for name, n in self.head["tables"].items():
            tables[name] = self._unpress.decompress(content[at : at + n])
            at += n
        read = lambda name, kind="<i8": np.frombuffer(tables[name], kind)
        self.n, self.first, self.width, self.zeros = self.head["n"], self.head["first"], self.head["width"], self.head["zeros"]
        self.documents, self.known, self.lengths = read("documents"), read("known", np.uint8), read("lengths")
        self.starts = self.first + np.concatenate([[0], np.cumsum(self.lengths)])
        self.each = -(-self.n // (8 * self.head["block"]))
        self.ones, self.ends = read("ones").reshape(self.width, self.each), read("ends")
        self._body, self._blocks = memoryview(content)[at:], {}

    def _block(self, plane: int, k: int) -> np.ndarray:
        """The bits of a block."""
        if (plane, k) not in self._blocks:
            place = plane * self.each + k
            start = int(self.ends[place - 1]) if place else 0
            self._blocks[plane, k] = np.unpackbits(np.frombuffer(self._unpress.decompress(self._body[start : int(self.ends[place])]), np.uint8), bitorder="little")
        return self._blocks[plane, k]

    def rank(self, plane: int, place: int) -> int:
        """Ones of a plane before a place."""
        k, rest = divmod(place, 8 * self.head["block"])
        return int(self.ones[plane, k]) + int(self._block(plane, k)[:rest].sum()) if k < self.each else self.n - self.zeros[plane]

    def select(self, plane: int, bit: int, nth: int) -> int:
        """The place of the nth (from 0) ``bit`` of a plane."""
        before = self.ones[plane] if bit else np.arange(self.each) * 8 * self.head["block"] - self.ones[plane]
        k = int(np.searchsorted(before, nth, side="right")) - 1
        return k * 8 * self.head["block"] + int(np.flatnonzero(self._block(plane, k) == bit)[nth - int(before[k])])

    def access(self, place: int) -> int:
        """The id at a place."""
        out = 0
        for p in range(self.width):
            k, rest = divmod(place, 8 * self.head["block"])
            bit = int(self._block(p, k)[rest])
            place = self.zeros[p] + self.rank(p, place) if bit else place - self.rank(p, place)
            out = 2 * out + bit
        return out

    def _span(self, token: int, upto: int) -> tuple[int, int]:
        """Where behind all planes the occurrences of an id in the first ``upto`` places lie."""
        a, b = 0, upto
        for p in range(self.width):
            if token >> (self.width - 1 - p) & 1:
                a, b = self.zeros[p] + self.rank(p, a), self.zeros[p] + self.rank(p, b)
            else:
                a, b = a - self.rank(p, a), b - self.rank(p, b)
        return a, b

    def count(self, token: int, upto: int | None = None) -> int:
        """Occurrences of an id, in all or in the first ``upto`` places."""
        if token >> self.width:
            return 0
        a, b = self._span(token, self.n if upto is None else upto)
        return b - a

    def occurrences(self, token: int) -> Iterator[int]:
        """The places of an id, in order."""
        if token >> self.width:
            return
        a, b = self._span(token, self.n)
        for place in range(a, b):
            for p in range(self.width - 1, -1, -1):
                bit = token >> (self.width - 1 - p) & 1
                place = self.select(p, bit, place - self.zeros[p] * bit)
            yield place

    def ids(self) -> np.ndarray:
        """All ids, from the last plane up."""
        seq = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for p in range(self.width - 1, -1, -1):
            lo, hi = p * self.each, (p + 1) * self.each
            cuts = [int(self.ends[i - 1]) if i else 0 for i in range(lo, hi + 1)]
            packed = b"".join(self._unpress.decompress(self._body[a:b]) for a, b in itertools.pairwise(cuts))
            on = np.unpackbits(np.frombuffer(packed, np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(seq)
            above[np.flatnonzero(~on)] = seq[: self.zeros[p]]
            above[np.flatnonzero(on)] = seq[self.zeros[p] :] | seq.dtype.type(1 << (self.width - 1 - p))
            seq = above
        return seq


def write(docs: DataFrame, path: str, encoder: Callable[[], object], shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the ids of all texts as shard files below ``path``; ``encoder`` makes an Encoder once in each worker.

    Rows meet in ranges of doc_id; a place in the input splits the rows of one doc_id and
    text, so ids that many rows share are no one task's work.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark").asc(), F.col("place").asc()]
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.monotonically_increasing_id().alias("place"), F.col("text").cast("string").alias("text"))
    ordered = picked.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        made, part = once(encoder), TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        docs_of: list[int | None] = []
        lengths: list[int] = []
        n = first = no = 0

        def file() -> tuple[str, bytes]:
            return f"{part:07d}-{no:07d}-{n}.wm", to_file(docs_of, lengths, np.concatenate(held), first, made.width)

        for batch in batches:
            for piece, _, _ in chunks(batch, most=SLICE_BYTES, rows=SLICE_ROWS):
                flat, bounds = made.encode(piece.column("text"))
                for d, a, b in zip(piece.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    if n and n + b - a > shard_tokens:
                        yield file()
                        first, no = first + n, no + 1
                        held, docs_of, lengths, n = [], [], [], 0
                    held.append(flat[a:b].astype(np.uint16 if made.width <= 16 else np.int32))
                    docs_of.append(d)
                    lengths.append(b - a)
                    n += b - a
        if docs_of:
            yield file()

    blobs.write_made(ordered, shards, path)


class WordTokenizer:
    """Makes the Encoder of a tokenizer file on the worker; named by file, so that workers keep it."""

    def __init__(self, path: str, end: int = END) -> None:
        self.key = (path, end)

    def __call__(self) -> Encoder:
        return Encoder(*self.key)


def _bases(files: DataFrame) -> DataFrame:
    """folder_no and how many ids the folders before it hold, from the names of files; one row for each task of the write."""
    sizes = files.select("folder_no", F.regexp_extract("name", r"-(\d+)\.wm$", 1).cast("long").alias("n"))
    per = sizes.groupBy("folder_no").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.orderBy("folder_no").rowsBetween(Window.unboundedPreceding, -1))
    return per.select("folder_no", F.coalesce(before, F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for folder, content in zip(batch.column("folder_no").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_py())
                ids, at = shard.ids().astype("<u4"), shard.starts - shard.first
                crc = [zlib.crc32(ids[a:b]) for a, b in itertools.pairwise(at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(crc), pa.int64()), pa.array(shard.documents, pa.int64(), mask=shard.known == 0), pa.array(shard.starts[:-1]), pa.array(shard.lengths), pa.array(crc, pa.int64())],
                    ["folder_no", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    files = blobs.read(spark, path)
    rows = files.mapInArrow(documents, "folder_no long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(_bases(files)), "folder_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, doc_id and place in the document of every occurrence of the tokens, looked up in the shards without decoding them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                shard = Shard(content.as_py())
                for token in tokens:
                    found = shard.occurrences(token)
                    while some := list(itertools.islice(found, 1 << 16)):
                        at = np.array(some, np.int64)
                        doc = np.searchsorted(shard.starts - shard.first, at, side="right") - 1
                        yield pa.RecordBatch.from_arrays([pa.array([token] * len(at), pa.int32()), pa.array(shard.documents[doc], pa.int64(), mask=shard.known[doc] == 0), pa.array(at - (shard.starts[doc] - shard.first))], ["token", "doc_id", "place"])

    return blobs.read(spark, path).mapInArrow(find, "token int, doc_id long, place long")

