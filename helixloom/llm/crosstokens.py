"""Alignment of two tokenizers' tokens over each text.

Both token sequences cover the same bytes (a space and the text). All tokens of a batch
are sorted by start, the running maximum of their ends is taken, and a group ends where a start reaches it.
Every token of one side is linked with every token of the other side in its
group. An id pair's count is the number of documents that hold it linked.

Tokens of both sides end where a word does, so no group reaches over it: a worker aligns a
word that it has seen before only once, and a text's groups and links are those of its words in turn.

Documents are encoded once and written with their distinct pairs, in chunks of about
CHUNK_BYTES of text. A chunk asks for the counts of its pairs once, so a pair that all documents have
is one row for each chunk and no key is hot; counts come back to chunks, not to documents. What is broadcast is
the highest count of each A id, a row for each entry of its vocabulary at most.

A text that is null or empty, or whose tokens' bytes are not the space and the text, has no tokens: zeros
and an empty digest. Repeated rows are documents of their own. An empty table gives no
rows; other columns are ignored; doc_id is an integer.
"""

from __future__ import annotations

import hashlib
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._shared import written
from helixloom.llm._text import chunks
from helixloom.llm.encoders import SLICE_ROWS, Grown, forget, gather, once, strings

CHUNK_BYTES = 8 << 20
#: Bytes of text that are looked at together, and words and pairs of words that a worker keeps.
SLICE_BYTES, CACHE_WORDS, CACHE_PAIRS = 2 << 20, 3 << 17, 1 << 22
#: New words that are aligned together, and those that go to a tokenizer as one text.
BATCH_WORDS, JOINED_WORDS = 1 << 13, 1 << 8
#: Links of a group up to which they are written out one by one before they are counted; beyond it distinct ids are.
PLAIN_LINKS = 1 << 12
#: B ids are below this, and A ids below 2 ** 32 / SIDE, so that a pair is stored in 32 bits.
SIDE = 1 << 15
_GAP = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Texts that are encoded whole: a space that doesn't begin a word of its own.
WHOLE = f"^ |  |{_GAP} (?:{_GAP}|$)| $"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Two tokenizers: ids of both for texts, and the bytes of their entries.

    Words are a space and what follows up to the next one. Neither tokenizer has a token over the
    beginning of a word whose space follows a character that is none and precedes one that is none; other texts are encoded whole.
    """

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_file), SentencePieceProcessor(model_file=piece_file)
        self.a.encode_special_tokens = True
        alphabet, size = byte_alphabet(), self.a.get_vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds the beginning of a word")
        if len(pieces) > SIDE or size > (1 << 32) // SIDE:
            raise ValueError("too many ids for a pair of 32 bits")
        entry = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(map(alphabet.__getitem__, t)) if all(c in alphabet for c in t) else t.encode() for t in entry]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.known = Known(self)
        # What a token adds to the digest's text: its id behind a comma (the same side), a bar (side B begins) or a semicolon (a group begins).
        self.printed = [(f"{sep}{i}").encode() for sep in ",|;" for i in range(max(size, len(pieces)))]
        self.ids, self.len_printed = max(size, len(pieces)), np.array(list(map(len, self.printed)))

    def _a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def _b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def whole(self, texts: list[str]) -> Sides:
        """(ids, bounds of texts) of both sides, without tokens where the bytes differ, and where they don't; each text by itself."""
        return self._equal(texts, [_flat(encode(texts) if texts else []) for encode in (self._a, self._b)])

    def by_word(self, words: list[str]) -> Sides:
        """The same for words without gaps: as a text of many words, divided where they end. Words of a text in which no token ends there go by themselves."""
        lines = [words[i : i + JOINED_WORDS] for i in range(0, len(words), JOINED_WORDS)]
        ends = [np.cumsum([len(w.encode()) + 1 for w in line]) for line in lines]
        sides = []
        for encode, length in ((self._a, self.len_a), (self._b, self.len_b)):
            flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for line, end, ids in zip(lines, ends, encode([" ".join(line) for line in lines]) if lines else [], strict=True):
                ids = np.array(ids, np.int32)
                reach = np.cumsum(length[ids])
                at = np.searchsorted(reach, end)
                if len(ids) and reach[-1] == end[-1] and (reach[at] == end).all():
                    n = np.diff(at, prepend=-1)
                else:
                    ids, bounds = _flat(encode(line))
                    n = np.diff(bounds)
                flat.append(ids)
                counts.append(n)
            sides.append((np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(counts))])))
        return self._equal(words, sides)

    def _equal(self, texts: list[str], sides: list[tuple[np.ndarray, np.ndarray]]) -> Sides:
        wanted = [f" {t}".encode() for t in texts]
        ends, together = np.cumsum([0, *map(len, wanted)]), b"".join(wanted)
        kept = np.ones(len(wanted), bool)
        for table, length, (ids, bounds) in zip((self.bytes_a, self.bytes_b), (self.len_a, self.len_b), sides, strict=True):
            listed = ids.tolist()
            # All at once; one by one only where that shows a difference.
            if not np.array_equal(np.concatenate([[0], np.cumsum(length[ids])])[bounds], ends) or b"".join(map(table.__getitem__, listed)) != together:
                kept &= np.array([b"".join(map(table.__getitem__, listed[a:b])) == w for w, (a, b) in zip(wanted, itertools.pairwise(bounds.tolist()), strict=True)], bool)
        out = []
        for ids, bounds in sides:
            n = np.where(kept, np.diff(bounds), 0)
            out.append((ids[np.repeat(kept, np.diff(bounds))], np.concatenate([[0], np.cumsum(n)])))
        return out[0], out[1], kept


#: (ids, bounds of texts) of the one tokenizer and of the other, and of which texts they have the bytes.
Sides = tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
    return np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(bounds[-1])), bounds


class Files:
    """Makes the Pair of two tokenizer files on the worker."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        self.key = (byte_file, piece_file)

    def __call__(self) -> Pair:
        return Pair(*self.key)


def coalesce(len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of both sides over the same bytes, in their order by start (A before B): their place (A's, then B's) and their group."""
    ends = np.concatenate([np.cumsum(len_a), np.cumsum(len_b)])
    starts = ends - np.concatenate([len_a, len_b])
    side = np.repeat([0, 1], [len(len_a), len(len_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, times) of the links of all groups; groups with more than PLAIN_LINKS hold each pair once, with its number."""
    n_a, n_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    first_b = np.concatenate([[0], np.cumsum(n_b)])
    large = n_a * n_b > PLAIN_LINKS
    plain = ~large[group_a]
    each = n_b[group_a[plain]]
    total = int(each.sum())
    shift = np.repeat(first_b[group_a[plain]] - (np.cumsum(each) - each), each)
    groups, pairs, times = [np.repeat(group_a[plain], each)], [np.repeat(a[plain], each).astype(np.int64) * SIDE + b[shift + np.arange(total)]], [np.ones(total, np.int64)]
    first_a = np.concatenate([[0], np.cumsum(n_a)])
    for g in np.flatnonzero(large):
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g + 1]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g + 1]], return_counts=True)
        groups.append(np.full(len(ids_a) * len(ids_b), g))
        pairs.append((ids_a[:, None].astype(np.int64) * SIDE + ids_b).ravel())
        times.append((times_a[:, None] * times_b).ravel())
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(times)


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_TYPES = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def aligned(pair: Pair, sides: Sides) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups and n_links of each text, its groups as the digest has them, and the distinct (text, pair, times)."""
    (a, bounds_a), (b, bounds_b), kept = sides
    n = len(kept)
    order, group = coalesce(pair.len_a[a], pair.len_b[b])
    of = np.empty(len(order), np.int64)
    of[order] = group
    n_groups = int(group[-1]) + 1 if len(group) else 0
    group_a, group_b = of[: len(a)], of[len(a) :]
    # A group lies in one text, as both sides end where a text does.
    text_of = np.zeros(n_groups, np.int64)
    text_of[group_a] = np.repeat(np.arange(n), np.diff(bounds_a))
    group, pairs, times = links(a, group_a, b, group_b, n_groups)
    text, pairs, times = _summed(text_of[group], pairs, times)
    # By group, A before B: printed ids of which the first of a side or a group has its own mark before it.
    ids, side = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
    place = np.argsort(of * 2 + side, kind="stable")
    mark = np.zeros(len(place), np.int64)
    mark[1:] = np.where(of[place][1:] != of[place][:-1], 2, side[place][1:] != side[place][:-1])
    codes = mark * pair.ids + ids[place]
    printed = b"".join(map(pair.printed.__getitem__, codes.tolist()))
    cuts = np.concatenate([[0], np.cumsum(pair.len_printed[codes])])[bounds_a + bounds_b]
    # The mark before a text's first id is left out.
    shown = [printed[s + 1 : e] for s, e in itertools.pairwise(cuts.tolist())]
    return [np.diff(bounds_a), np.diff(bounds_b), np.bincount(text_of, minlength=n)[:n], np.bincount(text, times, n).astype(np.int64)[:n]], shown, text, pairs, times


def _summed(text: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, pair) in order, with their times together."""
    key = (text << 32) | pairs
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at] >> 32, key[at] & 0xFFFFFFFF, np.add.reduceat(times[order], at) if len(at) else times


class Known:
    """Alignments of the words that a worker has seen: up to CACHE_WORDS words and about CACHE_PAIRS pairs of ids."""

    def __init__(self, pair: Pair) -> None:
        self.pair = pair
        self.place: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.per = [Grown(np.int64) for _ in range(4)]
        self.sound, self.seen, self.starts, self.lengths = Grown(bool), Grown(np.int32), Grown(np.int64), Grown(np.int64)
        self.pairs, self.times = Grown(np.uint32), Grown(np.int64)

    def _add(self, words: list[str], per: list[np.ndarray], shown: list[bytes], sound: np.ndarray, seen: np.ndarray, lengths: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        self.place.update(zip(words, itertools.count(len(self.place))))
        self.shown += shown
        self.starts.extend(self.pairs.n + np.cumsum(lengths) - lengths)
        for grown, values in zip((*self.per, self.sound, self.seen, self.lengths, self.pairs, self.times), (*per, sound, seen, lengths, pairs, times), strict=True):
            grown.extend(values)

    def _forget(self) -> None:
        """Keeps the words that came up again, unless they are most of all."""
        kept = [(w, at) for w, at in self.place.items() if self.seen.held[at] > 1]
        at = np.array([at for _, at in kept], np.int64)
        if 2 * len(kept) >= CACHE_WORDS or 2 * self.lengths.held[at].sum() >= CACHE_PAIRS:
            kept, at = [], at[:0]
        pairs, times = self.linked(at)
        rows = [w for w, _ in kept], [g.held[at] for g in self.per], [self.shown[i] for i in at.tolist()], self.sound.held[at], self.seen.held[at], self.lengths.held[at], pairs, times
        self.__init__(self.pair)
        self._add(*rows)

    def places(self, words: pa.Array) -> np.ndarray:
        """For each word where its alignment is kept, until the next call."""
        held = words.dictionary_encode()
        unique = strings(held.dictionary)
        if len(self.place) + len(unique) > CACHE_WORDS or self.pairs.n > CACHE_PAIRS:
            self._forget()
        new = pa.array([w for w in unique if w not in self.place], pa.string())
        gap = pc.match_substring_regex(new, _GAP)
        for some, encode in ((new.filter(pc.invert(gap)), self.pair.by_word), (new.filter(gap), self.pair.whole)):
            for i in range(0, len(some), BATCH_WORDS):
                listed = strings(some.slice(i, BATCH_WORDS))
                sides = encode(listed)
                per, shown, of, pairs, times = aligned(self.pair, sides)
                self._add(listed, per, shown, sides[2], np.zeros(len(listed), np.int32), np.bincount(of, minlength=len(listed)), pairs.astype(np.uint32), times)
        of = np.fromiter(map(self.place.__getitem__, unique), np.int64, len(unique))
        self.seen.held[of] += 1
        return of[held.indices.to_numpy(zero_copy_only=False)] if len(words) else of

    def linked(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and times of the words at these places in turn."""
        return tuple(gather(g.held, self.starts.held[places], self.lengths.held[places])[0] for g in (self.pairs, self.times))


def _slice(pair: Pair, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Columns n_a to groups_sha256 of some texts, and their distinct (text, pair, times)."""
    texts, n, known = pc.fill_null(texts, ""), len(texts), pair.known
    some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False).astype(bool)
    odd = some & pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False).astype(bool)
    split = pc.split_pattern(texts.filter(pa.array(some & ~odd)), " ")
    places = known.places(split.flatten())
    row = np.repeat(np.flatnonzero(some & ~odd), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    # Texts with a word whose bytes differ are encoded and compared whole.
    unsound = np.bincount(row[~known.sound.held[places]], minlength=n) > 0
    row, places, odd = row[~unsound[row]], places[~unsound[row]], odd | unsound
    per = [np.bincount(row, g.held[places], n).astype(np.int64) for g in known.per]
    listed = places.tolist()
    shown = [b";".join(map(known.shown.__getitem__, listed[s:e])) for s, e in itertools.pairwise(np.searchsorted(row, np.arange(n + 1)).tolist())]
    held, count = np.unique((row << 32) | places, return_counts=True)
    each = known.lengths.held[held & 0xFFFFFFFF]
    pairs, times = known.linked(held & 0xFFFFFFFF)
    rest = np.flatnonzero(odd)
    more, whole, text, *linked = aligned(pair, pair.whole(texts.take(pa.array(rest)).to_pylist()))
    for column, values in zip(per, more, strict=True):
        column[rest] = values
    for i, groups in zip(rest.tolist(), whole, strict=True):
        shown[i] = groups
    text, pairs, times = _summed(np.concatenate([np.repeat(held >> 32, each), rest[text]]), np.concatenate([pairs.astype(np.int64), linked[0]]), np.concatenate([times * np.repeat(count, each), linked[1]]))
    return [*per, [hashlib.sha256(x).hexdigest() if x else "" for x in shown]], text, pairs, times


def align(docs: DataFrame, pair: Files, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ALIGNED: every document with its distinct linked pairs, and for each chunk one row with doc_id null and n_a -1, whose times are the documents that hold a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = once(pair), TaskContext.get().partitionId() << 32
        no = size = 0
        seen: list[np.ndarray] = []
        for batch in batches:
            for piece, raw, _ in chunks(batch, most=SLICE_BYTES, rows=SLICE_ROWS):
                if size and size + len(raw) > chunk_bytes:
                    yield _asked(part + no, seen)
                    no, size, seen = no + 1, 0, []
                size += len(raw)
                per, text, pairs, times = _slice(made, piece.column("text"))
                seen.append(pairs)
                cuts = np.searchsorted(text, np.arange(len(piece) + 1)).tolist()
                pack = lambda v: pa.array([v[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part + no] * len(piece), pa.int64()), piece.column("doc_id"), *map(pa.array, per), pack(pairs.astype(np.uint32)), pack(times.astype(np.uint32))], schema=_TYPES)
        if size or seen:
            yield _asked(part + no, seen)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, ALIGNED)


def _asked(chunk: int, seen: list[np.ndarray]) -> pa.RecordBatch:
    pairs, n = np.unique(np.concatenate(seen), return_counts=True)
    return pa.RecordBatch.from_pylist([{"chunk": chunk, "n_a": -1, "pairs": pairs.astype(np.uint32).tobytes(), "times": n.astype(np.uint32).tobytes()}], _TYPES)


def _unpacked(rows: DataFrame) -> DataFrame:
    """chunk, pair and n of the chunks' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, times in zip(batch.column("chunk").to_pylist(), batch.column("pairs"), batch.column("times"), strict=True):
                pairs, times = np.frombuffer(pairs.as_py(), np.uint32).astype(np.int64), np.frombuffer(times.as_py(), np.uint32)
                for at in range(0, len(pairs), 1 << 16):
                    some = pairs[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), chunk)), pa.array(some), pa.array(times[at : at + (1 << 16)].astype(np.int64))], ["chunk", "pair", "n"])

    return rows.select("chunk", "pairs", "times").mapInArrow(run, "chunk long, pair long, n long")


def counted(docs: DataFrame, pair: Files, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    aligned = written(align(docs, pair, chunk_bytes), "token-links")
    asked = written(_unpacked(aligned.filter("n_a < 0")), "token-pairs")
    totals = written(asked.groupBy("pair").agg(F.sum("n").alias("total")), "token-pair-counts")
    best = totals.groupBy(F.floor(F.col("pair") / SIDE).alias("a")).agg(F.max("total").alias("most"))
    told = totals.withColumn("a", F.floor(F.col("pair") / SIDE)).join(F.broadcast(best), "a").select("pair", "total", (F.col("total") == F.col("most")).alias("top"))
    back = asked.select("chunk", "pair").join(told, "pair").select("chunk", "pair", "total", "top")

    def add(held: pa.Table, counts: pa.Table) -> pa.Table:
        forget()
        order = np.argsort(counts.column("pair").to_numpy())
        known, total, top = counts.column("pair").to_numpy()[order], counts.column("total").to_numpy()[order], counts.column("top").to_numpy()[order]
        lengths = np.array([len(x) // 4 for x in held.column("pairs").to_pylist()], np.int64)
        pairs = np.frombuffer(b"".join(held.column("pairs").to_pylist()), np.uint32).astype(np.int64)
        times = np.frombuffer(b"".join(held.column("times").to_pylist()), np.uint32).astype(np.int64)
        at = np.searchsorted(known, pairs)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[cuts])
        out = held.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        return out.append_column("n_best", pa.array(sums(times * top[at]) if len(known) else np.zeros(len(lengths), np.int64))).append_column("count_sum", pa.array(sums(times * total[at]) if len(known) else np.zeros(len(lengths), np.int64)))

    documents = aligned.filter("n_a >= 0")
    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return documents.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(add, result).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
