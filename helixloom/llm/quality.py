"""Quality classifier: ridge regression on random Fourier features of document statistics.

Statistics of each whole text are standardised; cosines of random projections
approximate a Gaussian kernel over them. Every partition sums its part of the normal
equations, the sums are added up row by row of the matrix, and the driver solves one
system of FEATURES unknowns. Isotonic regression on rows that the ridge didn't see turns
its values into probabilities; it works on counts in CALIBRATION_BINS bins, so the
driver gets a fixed number of rows.

Nulls: null text counts as empty; labels with a null doc_id or quality are ignored,
several labels of a document are averaged. Without labels every score is 0.5. Repeated
rows get the same result each, an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixloom.llm._text import chunks, lines, lower, mix64, per_row, span_hashes, words

FEATURES = 256
CALIBRATION_BINS = 2000
#: What is measured of a text, in this order.
STATISTICS = "log_bytes log_words word_length word_length_sd longest_word upper digit stop_mark bang bar symbol space wide line_length lines_per_word short_line repeated_line distinct_word top_word repeated_pair upper_word short_word entropy".split()


def _repeats(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of its most frequent one."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(r)))
    top = np.zeros(n)
    np.maximum.at(top, r[at], runs)
    return np.bincount(r[at], minlength=n), top


def measure(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATISTICS of each row, as float64."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    low = lower(raw)
    kind = lambda mask: per_row(mask, offsets) / some
    starts, ends, first = words(raw, offsets)
    row_w = np.repeat(np.arange(n), np.diff(first))
    n_words = np.diff(first).astype(np.float64)
    some_w = np.maximum(n_words, 1)
    length = (ends - starts).astype(np.float64)
    mean = per_row(length, first) / some_w
    sd = np.sqrt(np.maximum(per_row(length * length, first) / some_w - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, row_w, length)
    hashes = span_hashes(low, starts, ends)
    distinct, top = _repeats(row_w, hashes, n)
    inside = np.flatnonzero(row_w[1:] == row_w[:-1])
    pair = mix64(hashes[inside] * np.uint64(3) + hashes[inside + 1])
    distinct_pair, _ = _repeats(row_w[inside], pair, n)
    upper = (raw >= 65) & (raw <= 90)
    ups = np.concatenate([[0], np.cumsum(upper)])
    ls, le, lf = lines(raw, offsets)
    row_l = np.repeat(np.arange(n), np.diff(lf))
    n_lines = np.diff(lf).astype(np.float64)
    distinct_line, _ = _repeats(row_l, span_hashes(raw, ls, le), n)
    letter = (low >= 97) & (low <= 122)
    digit = (raw >= 48) & (raw <= 57)
    stop = (raw == 44) | (raw == 46) | (raw == 59) | (raw == 58)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    symbol = (raw < 128) & ~letter & ~digit & ~stop & ~space & (raw != 33) & (raw != 124)
    counts = np.bincount(np.repeat(np.arange(n) * 64, np.diff(offsets)) + (low & 63), minlength=64 * n).reshape(n, 64) / some[:, None]
    entropy = -(counts * np.log(np.maximum(counts, 1e-12))).sum(axis=1)
    return np.stack(
        [
            np.log1p(size), np.log1p(n_words), np.log1p(mean), np.log1p(sd), np.log1p(longest),
            kind(upper), kind(digit), kind(stop), kind(raw == 33), kind(raw == 124), kind(symbol), kind(space), kind(raw > 127),
            np.log1p(size / n_lines), n_lines / some_w, per_row(le - ls < 30, lf) / n_lines, 1 - distinct_line / n_lines,
            distinct / some_w, top / some_w, 1 - distinct_pair / np.maximum(n_words - 1, 1),
            per_row(ups[ends] - ups[starts] >= 0.6 * length, first) / some_w, per_row(length <= 3, first) / some_w, entropy,
        ],
        axis=1,
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats array<double> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch):
                values = measure(raw, offsets)
                at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()))], ["doc_id", "stats"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Model:
    """Scaling, random projection, ridge solution and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray] | None = None

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        phi = np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.project + self.phase)
        return np.concatenate([phi, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        value = self.raw(stats)
        return value.clip(0, 1) if self.steps is None else np.interp(value, *self.steps).clip(0, 1)


def isotonic(at: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and never falling means, to interpolate between."""
    blocks: list[list[float]] = []
    for x, s, n in zip(at, total, count, strict=True):
        blocks.append([x * n, s, n, x, x])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            b = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3], b[4]]
    places = [p for b in blocks for p in (b[3], b[4])]
    means = [b[1] / b[2] for b in blocks for _ in range(2)]
    return np.array(places), np.array(means)


def fit(fit_rows: DataFrame, calibrate_rows: DataFrame, features: int = FEATURES, ridge: float = 1e-3, seed: int = 7) -> Model | None:
    """The model of rows (stats, label), calibrated on others; None without rows."""
    k = len(STATISTICS)
    moments = fit_rows.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("stats")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not moments["n"]:
        return None
    rng = np.random.default_rng(seed)
    mean = np.array([moments[f"m{i}"] for i in range(k)])
    scale = np.maximum(np.array([moments[f"s{i}"] for i in range(k)]), 1e-6)
    project = rng.normal(size=(k, features)) / np.sqrt(k / 2)
    model = Model(mean, scale, project, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                phi = model.lift(_matrix(part.column("stats")))
                y = part.column("label").to_numpy(zero_copy_only=False)
                now = phi.T @ np.concatenate([phi, y[:, None]], axis=1)
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(features + 2)
        for chunk in table.column("sums").chunks:
            for x in chunk:
                total += np.frombuffer(x.as_py())
        return pa.table({"i": table.column("i").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    sums = fit_rows.select("stats", "label").mapInArrow(partial, "i int, sums binary").groupBy("i").applyInArrow(add, "i int, sums binary")
    rows = sorted(sums.toArrow().to_pylist(), key=lambda r: r["i"])
    system = np.stack([np.frombuffer(r["sums"]) for r in rows])
    n = moments["n"]
    penalty = ridge * n * np.eye(features + 1) / features
    penalty[-1, -1] = 1e-9
    weights = np.linalg.solve(system[:, :-1] + penalty, system[:, -1])
    model = Model(model.mean, model.scale, model.project, model.phase, weights)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = model.raw(_matrix(batch.column("stats")))
                yield pa.RecordBatch.from_arrays([pa.array(value), batch.column("label")], ["value", "label"])

    scored = calibrate_rows.select("stats", "label").mapInArrow(values, "value double, label double")
    half = CALIBRATION_BINS // 4
    bins = scored.groupBy(F.least(F.greatest(F.round(F.col("value") * half), F.lit(-half)), F.lit(3 * half)).alias("bin")).agg(F.sum("label").alias("total"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("at"))
    got = bins.orderBy("bin").toPandas()
    if not len(got):
        return model
    return Model(model.mean, model.scale, model.project, model.phase, weights, isotonic(got["at"].to_numpy(), got["total"].to_numpy(), got["n"].to_numpy()))


def score(measured: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of statistics()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.full(batch.num_rows, 0.5) if model is None or not batch.num_rows else model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return measured.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def labelled(measured: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, stats and label (the mean of a document's labels) of the rows that have one."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.avg("label").alias("label"))
    return measured.join(known, "doc_id")
