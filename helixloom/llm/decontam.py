"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case. A first
pass counts how often the corpus holds each SEED_WORDS-gram of the items. Of every stretch of STRETCH_WORDS words
of an item the rarest gram, by what it would cost (occurrences in the corpus times items that hold it), is a seed, so
that a run of that many words in common is always seen, whatever else is frequent. Hits of an item's seeds in a document that lie
within its length of each other are one passage. A passage with too few words of the item to
reach the threshold even if all of them matched is left at that, which costs no result; for the
others a Smith-Waterman alignment over words
(match 2, mismatch and gap -1) of the whole item against the passage gives the score, as
a share of the item's perfect score, or of that of FULL_WORDS words for a longer item, so
that the half of 26 words counts as a leak however long the item is. What has no
STRETCH_WORDS successive words of an item, and none of its seeds either, is not compared with it. An item of fewer than
SHORT_WORDS words is matched word for word only; as it may be a common phrase, hits in documents of more than SHORT_SHARE
times its words are marked as a mention, and it is for the caller to keep or to drop those.

The benchmark is worked through in blocks of about BLOCK_WORDS words, each broadcast with its
seeds (some 24 bytes a word) to two passes over the documents, one that counts and one that compares, so what is broadcast is bounded whatever the size of the
benchmark; an item of more than ITEM_WORDS words is cut into overlapping parts, which are items of their own here.

Nulls: a document with null text has no passage, an item with null text or fewer than
SEED_WORDS words matches only if it has words at all, by its whole sequence. Documents with a null doc_id or
repeated rows are each searched. An empty table on either side gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm._shared import written
from helixloom.llm._text import chunks, grams, lower, mix64, span_hashes, words

SEED_WORDS = 3
STRETCH_WORDS = 6
BLOCK_WORDS = 1 << 21
ITEM_WORDS = 400
FULL_WORDS = 26
THRESHOLD = 0.5
SHORT_WORDS = 8
SHORT_SHARE = 4
_CELLS = 1 << 20
#: Hits times items that are looked at together.
_SLOTS = 1 << 22
_CHUNK = 1 << 19
_BITS = 20

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each row's words begin."""
    plain = _PLAIN[lower(raw)]
    starts, ends, first = words(plain, offsets)
    return span_hashes(plain, starts, ends), first


@dataclass(frozen=True)
class Lookup:
    """A set of hashes with a bitmap that turns most strangers away before the search."""

    keys: np.ndarray
    bitmap: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray) -> Lookup:
        keys = np.unique(hashes)
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[keys & np.uint64((1 << _BITS) - 1)] = True
        return Lookup(keys, bitmap)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``hashes`` are keys, and which keys they are."""
        maybe = np.flatnonzero(self.bitmap[hashes & np.uint64((1 << _BITS) - 1)])
        if not len(self.keys) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.searchsorted(self.keys, hashes[maybe]).clip(max=len(self.keys) - 1)
        same = self.keys[at] == hashes[maybe]
        return maybe[same], at[same]


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word sequences, match 2, mismatch and gap -1."""
    scores = np.zeros(len(items))
    order = np.argsort([len(p) for p in passages], kind="stable")
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and (to + 1 - at) * len(passages[order[to]]) <= _CELLS:
            to += 1
        pick = order[at:to]
        wide, tall = max(len(passages[i]) for i in pick), max(len(items[i]) for i in pick)
        text = np.zeros((len(pick), wide), np.uint64)
        item = np.zeros((len(pick), tall), np.uint64)
        there = np.zeros((len(pick), wide), bool)
        for k, i in enumerate(pick):
            text[k, : len(passages[i])] = passages[i]
            there[k, : len(passages[i])] = True
            item[k, : len(items[i])] = items[i]
        length = np.array([len(items[i]) for i in pick])
        before = np.zeros((len(pick), wide + 1), np.int32)
        best = np.zeros(len(pick), np.int32)
        steps = np.arange(wide, dtype=np.int32)
        for r in range(tall):
            hit = np.where((text == item[:, r : r + 1]) & there, 2, -1).astype(np.int32)
            now = np.maximum(np.maximum(before[:, :-1] + hit, before[:, 1:] - 1), 0)
            now = np.maximum.accumulate(now + steps, axis=1) - steps
            np.maximum(best, np.where(r < length, now.max(axis=1), 0), out=best)
            before[:, 1:] = now
        scores[pick] = best
        at = to
    return scores


def _block(rows: list[tuple[int, str]]) -> tuple[list[int], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Item ids, their words, and hashes and places of their grams; short items have one gram of all words."""
    ids, seqs, keys, places = [], [], [], []
    for item_id, text in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        all_words, _ = tokens(raw, np.array([0, len(raw)]))
        for at in range(0, max(1, len(all_words) - ITEM_WORDS // 2), ITEM_WORDS // 2):
            seq = all_words[at : at + ITEM_WORDS]
            if len(seq):
                key, place = grams(seq, np.array([0, len(seq)]), min(SEED_WORDS, len(seq)))
                ids.append(item_id), seqs.append(seq), keys.append(key), places.append(place)
    return ids, seqs, keys, places


def _salted(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Hashes of words as words of their items."""
    return mix64(words + mix64(item.astype(np.uint64) + np.uint64(1)))


def _common(lookup: Lookup, token: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many words between low and high are words of the item."""
    total, size = np.zeros(len(item), np.int64), high - low
    ends = np.cumsum(size)
    at = 0
    while at < len(item):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + _CELLS, side="right")))
        which = np.repeat(np.arange(at, to), size[at:to])
        place = np.arange(len(which)) - (ends[which] - size[which] - (ends[at] - size[at])) + low[which]
        held = lookup.find(_salted(token[place], item[which]))[0]
        total[at:to] = np.bincount(which[held] - at, minlength=to - at)
        at = to
    return total


def _counts(docs: DataFrame, keys: dict[int, Lookup]) -> dict[int, np.ndarray]:
    """How often the documents hold each gram of a block, by the grams' number of words; tasks send their sums."""
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {n: np.zeros(len(lookup.keys), np.int64) for n, lookup in held.value.items()}
        for batch in batches:
            for _, raw, offsets in chunks(batch, most=_CHUNK):
                token, first = tokens(raw, offsets)
                for n, lookup in held.value.items():
                    which = lookup.find(grams(token, first, n)[0])[1]
                    sums[n] += np.bincount(which, minlength=len(sums[n]))
        for n, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(total[at])], ["n", "key", "times"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n long, key long, times long").groupBy("n", "key").agg(F.sum("times").alias("times")).toArrow()
    out = {n: np.zeros(len(lookup.keys), np.int64) for n, lookup in keys.items()}
    n_of, key, times = (found.column(c).to_numpy() for c in ("n", "key", "times"))
    for n in out:
        out[n][key[n_of == n]] = times[n_of == n]
    return out


def rarest(cost: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """Places of the cheapest of every ``width`` neighbours, the lowest key of equals; of all if there are fewer."""
    rank = np.empty(len(cost), np.int64)
    rank[np.lexsort((key, cost))] = np.arange(len(cost))
    width = min(width, len(cost))
    seen = np.lib.stride_tricks.sliding_window_view(rank, width)
    return np.unique(seen.argmin(axis=1) + np.arange(len(seen)))


def _index(docs: DataFrame, seqs: list[np.ndarray], keys: list[np.ndarray], places: list[np.ndarray], stretch: int) -> tuple[dict, np.ndarray]:
    """For each number of words: seeds, bounds of their entries, items and first places; and how far an item's equal seeds lie apart."""
    by_size: dict[int, list[int]] = {}
    for i, seq in enumerate(seqs):
        by_size.setdefault(min(SEED_WORDS, len(seq)), []).append(i)
    lookups = {n: Lookup.of(np.concatenate([keys[i] for i in own])) for n, own in by_size.items()}
    times, index, slack = _counts(docs, lookups), {}, np.zeros(len(seqs), np.int64)
    for n, own in by_size.items():
        at = {i: np.searchsorted(lookups[n].keys, keys[i]) for i in own}
        items = np.bincount(np.concatenate([np.unique(x) for x in at.values()]), minlength=len(lookups[n].keys))
        cost, key, item, place = (times[n] + 1) * items, [], [], []
        for i in own:
            seed = rarest(cost[at[i]], keys[i], stretch - n + 1)
            # An item's equal grams are one entry, and its passages begin as much earlier.
            once, begin, which = np.unique(keys[i][seed], return_index=True, return_inverse=True)
            slack[i] = (places[i][seed] - places[i][seed][begin][which]).max(initial=0)
            key.append(once), item.append(np.full(len(once), i)), place.append(places[i][seed][begin])
        key, item, place = (np.concatenate(x) for x in (key, item, place))
        order = np.argsort(key, kind="stable")
        lookup = Lookup.of(key)
        index[n] = (lookup, np.append(np.searchsorted(key[order], lookup.keys), len(key)), item[order], place[order])
    return index, slack


def _slots(index: dict, token: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in the text, item, place in the item) of all hits, some items at a time, so that no more than about _SLOTS are held."""
    hits = []
    for n, (lookup, bounds, item, place) in index.items():
        key, at = grams(token, first, n)
        hit, which = lookup.find(key)
        hits.append((at[hit], which, bounds, item, place))
    per = [np.bincount(which, minlength=len(bounds) - 1) for _, which, bounds, _, _ in hits]
    total = sum(int((p * np.diff(h[2])).sum()) for p, h in zip(per, hits, strict=True))
    cuts = [0, 1 + max((int(h[3].max(initial=0)) for h in hits), default=0)]
    if total > _SLOTS:
        of_item = sum(np.bincount(h[3], np.repeat(p, np.diff(h[2])), cuts[1]) for p, h in zip(per, hits, strict=True))
        cuts = np.unique(np.concatenate([[0], 1 + np.flatnonzero(np.diff(np.cumsum(of_item) // _SLOTS)), [cuts[1]]])).tolist()
    for low, high in zip(cuts, cuts[1:], strict=False):
        found = []
        for at, which, bounds, item, place in hits:
            inside = (item >= low) & (item < high)
            before = np.concatenate([[0], np.cumsum(inside)])
            mine, begin = np.diff(before[bounds]), before[bounds[:-1]]
            many = mine[which]
            slot = np.repeat(begin[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(at, many), item[inside][slot], place[inside][slot]))
        yield tuple(np.concatenate([f[j] for f in found]) for j in range(3))


FOUND = "doc_id long, item_id long, score double, from_word long, to_word long, mention boolean"


def _search(docs: DataFrame, rows: list[tuple[int, str]], threshold: float, stretch: int) -> DataFrame:
    ids, seqs, keys, places = _block(rows)
    index, slack = _index(docs, seqs, keys, places, stretch)
    own = Lookup.of(_salted(np.concatenate(seqs), np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])))
    held = docs.sparkSession.sparkContext.broadcast((ids, seqs, index, slack, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seqs, index, slack, own = held.value
        size = np.array([len(s) for s in seqs])
        for batch in batches:
            for part, raw, offsets in chunks(batch, most=_CHUNK):
                token, first = tokens(raw, offsets)
                for at, item, place in _slots(index, token, first):
                    row = np.searchsorted(first, at, side="right") - 1
                    if not len(at):
                        continue
                    start = at - place
                    order = np.lexsort((start, item, row))
                    row, item, start = row[order], item[order], start[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > (size + slack)[item[1:]])
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(row)) - 1
                    row, item = row[head], item[head]
                    pad = size[item] // 2 + 4
                    low = np.maximum(start[head] - pad - slack[item], first[row])
                    high = np.minimum(start[tail] + size[item] + pad, first[row + 1])
                    able = _common(own, token, item, low, high) >= threshold * np.minimum(size[item], FULL_WORDS)
                    row, item, low, high = row[able], item[able], low[able], high[able]
                    share = align([seqs[i] for i in item], [token[a:b] for a, b in zip(low, high, strict=True)]) / np.maximum(2 * np.minimum(size[item], FULL_WORDS), 1)
                    share = np.minimum(share, 1.0)
                    short = size[item] < SHORT_WORDS
                    ok = share >= np.where(short, 1.0, threshold)
                    mention = short & (first[row + 1] - first[row] > SHORT_SHARE * size[item])
                    doc = part.column("doc_id").take(pa.array(row[ok]))
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array([ids[i] for i in item[ok]], pa.int64()), pa.array(share[ok]), pa.array(low[ok] - first[row[ok]], pa.int64()), pa.array(high[ok] - first[row[ok]], pa.int64()), pa.array(mention[ok])],
                        ["doc_id", "item_id", "score", "from_word", "to_word", "mention"],
                    )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, FOUND)


def passages(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS, stretch: int = STRETCH_WORDS) -> DataFrame:
    """doc_id, item_id, score, from_word, to_word and mention of every passage that scores at least ``threshold``."""
    spark: SparkSession = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().filter("text != ''").distinct()
    n_words = items.agg(F.sum(F.size(F.split("text", r"[^A-Za-z0-9\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    n_blocks = -(-n_words // block_words)
    out = None
    for b in range(n_blocks):
        mine = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        rows = sorted((r["item_id"], r["text"]) for r in mine.collect())
        rows = [r for r in rows if len(tokens(np.frombuffer(r[1].encode(), np.uint8), np.array([0, len(r[1].encode())]))[0])]
        if rows:
            found = _search(docs, rows, threshold, stretch)
            found = found if n_blocks == 1 else written(found, "decontam-block")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], FOUND) if out is None else out


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and item_id of every document with a passage from the item, its best score and number of passages, and whether it only mentions a short item."""
    found = passages(docs, benchmark, threshold)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_passages"), F.min("from_word").alias("from_word"), F.bool_and("mention").alias("mention"))
