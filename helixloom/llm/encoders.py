"""Token ids of whole texts, word by word through a cache.

Where a tokenizer never lets a token or a rule reach over a gap between two words, the ids
of a text are those of its words in turn. Each worker therefore encodes a word it has seen
before only once; words go to the tokenizer's library whole, in batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Words that a worker keeps; beyond that it forgets those that came up once.
CACHE_WORDS = 1 << 19
#: Bytes of text that are looked at together: the more, the fewer words come up again.
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 16


def strings(column: pa.Array) -> list[str]:
    """The strings of a column without nulls; many times faster than one by one."""
    return column.to_numpy(zero_copy_only=False).tolist()


class Grown:
    """An array that takes more."""

    def __init__(self, kind: type) -> None:
        self.held, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.held):
            self.held = np.concatenate([self.held[: self.n], np.zeros(max(self.n, len(values)), self.held.dtype)])
        self.held[self.n : self.n + len(values)] = values
        self.n += len(values)


class Words:
    """Ids of words from ``encode``, which maps a list of strings to their ids, or from ``joined``, which gives all ids in turn and each word's bounds."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = CACHE_WORDS, joined: Callable[[list[str]], tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.encode, self.most, self.joined = encode, most, joined or self._listed
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.lengths, self.times = Grown(np.int32), Grown(np.int64), Grown(np.int64), Grown(np.int32)

    def _listed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(words)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        return np.fromiter(itertools.chain.from_iterable(found), np.int32, int(bounds[-1])), bounds

    def _forget(self) -> None:
        """Keeps the words that came up again, unless they are most of all."""
        kept = [(w, at) for w, at in self.place.items() if self.times.held[at] > 1]
        kept = kept if 2 * len(kept) < self.most else []
        at = np.array([at for _, at in kept], np.int64)
        flat, bounds = self.gathered(at)
        times = self.times.held[at]
        self.__init__(self.encode, self.most, self.joined)
        self.place = {w: i for i, (w, _) in enumerate(kept)}
        for grown, values in ((self.flat, flat), (self.starts, bounds[:-1]), (self.lengths, np.diff(bounds)), (self.times, times)):
            grown.extend(values)

    def places(self, words: pa.Array) -> np.ndarray:
        """For each word where its ids are kept, until the next call."""
        held = words.dictionary_encode()
        unique = strings(held.dictionary)
        if len(self.place) + len(unique) > self.most:
            self._forget()
        of = np.fromiter(map(self.place.get, unique, itertools.repeat(-1)), np.int64, len(unique))
        unseen = of < 0
        new = list(itertools.compress(unique, unseen))
        of[unseen] = len(self.place) + np.arange(len(new))
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            flat, bounds = self.joined(some)
            self.starts.extend(self.flat.n + bounds[:-1])
            self.lengths.extend(np.diff(bounds))
            self.times.extend(np.zeros(len(some), np.int32))
            self.flat.extend(flat)
            self.place.update(zip(some, itertools.count(len(self.place))))
        self.times.held[of] += 1
        return of[held.indices.to_numpy(zero_copy_only=False)] if len(words) else of

    def gathered(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words at these places in turn, and the bounds of each word's ids."""
        return gather(self.flat.held, self.starts.held[places], self.lengths.held[places])

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.gathered(self.places(words))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of values one after another, and their bounds in the result."""
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    kind = np.int32 if max(len(values), bounds[-1]) < 1 << 31 else np.int64
    at = np.repeat((starts - bounds[:-1]).astype(kind), lengths)
    at += np.arange(bounds[-1], dtype=kind)
    return values.take(at), bounds


def interleave(plain: np.ndarray, by_word: tuple[np.ndarray, np.ndarray], whole: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids and bounds of rows, of which those in ``plain`` have theirs in by_word (ids, bounds) and the others in ``whole``, in turn."""
    flat, bounds = by_word
    rest = np.array([i for ids in whole for i in ids], np.int32)
    n = np.zeros(len(plain), np.int64)
    n[plain], n[~plain] = np.diff(bounds), [len(ids) for ids in whole]
    starts = np.zeros(len(plain), np.int64)
    starts[plain] = bounds[:-1]
    starts[~plain] = len(flat) + np.cumsum([0, *[len(ids) for ids in whole]])[:-1]
    return gather(np.concatenate([flat, rest]), starts, n)


_made: dict[object, object] = {}


def once(make: Callable[[], object]) -> object:
    """What ``make`` returned first in this worker: the tasks of a query share the words they have seen. Makers of one ``key`` are the same."""
    key = getattr(make, "key", make)
    if key not in _made:
        _made.clear()
        _made[key] = make()
    return _made[key]


def forget() -> None:
    """Lets go of what once() made, in a worker that goes on to something else."""
    _made.clear()
