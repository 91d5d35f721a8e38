"""Language identification: a language family first, then one-versus-one linear SVMs within it.

Features are the relative frequencies of hashed byte 1- to 3-grams of the lower-cased
text, under the square root, so each text is a unit vector whatever its length. Family
SVMs are one against the rest; within a family every pair of languages has an SVM and
the language that wins the most (ties: by summed margins) is predicted.

The models are fitted on the driver from a sample of at most SAMPLE_ROWS labelled texts
in expectation, spread evenly over the languages; prediction reads whole texts of all
rows. Where there are more languages than SAMPLE_ROWS, the most frequent are learned. Null text, or text without a letter, gives ``und`` with score 0. Without any
labelled row all are ``und``. Repeated rows get the same result each; rows with null
lang are never learned from; extra columns are kept where a caller asks for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixloom.llm._text import chunks, lower

DIMENSIONS = 1024
SAMPLE_ROWS = 6000
#: ISO 639-1 codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "turkic": "tr az kk uz",
    "indo-aryan": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of unit length, zeros for empty texts."""
    n = len(offsets) - 1
    low = np.concatenate([lower(raw), np.full(2, 32, np.uint8)]).astype(np.uint32)
    size = np.diff(offsets)
    base = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, size)
    left = np.repeat(offsets[1:], size) - np.arange(len(raw))
    one = low[:-2]
    two = np.where(left > 1, low[1:-1], 32)
    three = np.where(left > 2, low[2:], 32)
    out = np.zeros(n * DIMENSIONS, np.float32)
    for gram, seed in ((one, 1), (one | two << 8, 2), (one | two << 8 | three << 16, 3)):
        code = ((gram + np.uint32(seed << 24)) * np.uint32(2654435761)) >> np.uint32(22)
        out += np.bincount(base + code, minlength=len(out)).astype(np.float32)
    out = out.reshape(n, DIMENSIONS)
    return np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 4.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; y is -1 or 1."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    mean = x.mean(axis=0)
    z = x - mean
    v = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        v = z.T @ (z @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    rate = 1.0 / (1.0 + 2 * cost * float(weight.max()) * (float(np.linalg.norm(z @ v)) ** 2 * 1.1 + len(y)))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    w_near, b_near, t = w, b, 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ w_near + b_near)) * y * weight
        w_next = w_near - rate * (w_near - 2 * cost * (z.T @ slack))
        b_next = b_near + rate * 2 * cost * float(slack.sum())
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_near, b_near = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, b - float(mean @ w)


@dataclass(frozen=True)
class Model:
    """Weights of all SVMs as columns, biases, and which families and pairs they stand for."""

    families: tuple[str, ...]
    members: tuple[tuple[str, ...], ...]
    pairs: tuple[tuple[int, int, int], ...]
    weights: np.ndarray
    biases: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights + self.biases
        sure = 1 / (1 + np.exp(-3 * np.clip(margins, -10, 10)))
        n_family = len(self.families)
        family = margins[:, :n_family].argmax(axis=1)
        by_family = sure[:, :n_family] / np.maximum(sure[:, :n_family].sum(axis=1, keepdims=True), 1e-9)
        score = by_family[np.arange(len(x)), family]
        langs = np.empty(len(x), object)
        for f, names in enumerate(self.members):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(names)))
            belief = np.zeros((len(rows), len(names)))
            for k, (of, i, j) in enumerate(self.pairs):
                if of == f:
                    p = sure[rows, n_family + k]
                    votes[:, i] += (p >= 0.5) + 1e-3 * p
                    votes[:, j] += (p < 0.5) + 1e-3 * (1 - p)
                    belief[:, i] += p
                    belief[:, j] += 1 - p
            best = votes.argmax(axis=1)
            langs[rows] = np.array(names, object)[best]
            if len(names) > 1:
                score[rows] *= belief[np.arange(len(rows)), best] / (len(names) - 1)
        return list(langs), score.clip(0, 1)


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of the rows (doc_id, text, lang) whose text and lang are not null."""
    known = labelled.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample_rows).collect()}
    if not counts:
        return None
    each = sample_rows / len(counts)
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, each / n))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.filter(place < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch, rows=1024):
                x = features(raw, offsets)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, x binary").toArrow()
    names = np.array(rows.column("lang").to_pylist(), object)
    if not len(names):
        return None
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(len(names), -1)
    order = np.lexsort(([r.tobytes() for r in x[:, :64]], names))
    x, names = x[order], names[order]
    family_of = np.array([_FAMILY.get(n.lower().replace("_", "-").split("-")[0], n) for n in names], object)
    families = tuple(sorted(set(family_of)))
    members = tuple(tuple(sorted(set(names[family_of == f]))) for f in families)
    models, pairs = [], []
    for f in families:
        models.append(fit_svm(x, np.where(family_of == f, 1, -1).astype(np.float32)) if len(families) > 1 else (np.zeros(x.shape[1], np.float32), 1.0))
    for f, langs in enumerate(members):
        for i, j in combinations(range(len(langs)), 2):
            rows_ij = np.flatnonzero((names == langs[i]) | (names == langs[j]))
            models.append(fit_svm(x[rows_ij], np.where(names[rows_ij] == langs[i], 1, -1).astype(np.float32)))
            pairs.append((f, i, j))
    return Model(families, members, tuple(pairs), np.stack([w for w, _ in models], axis=1).astype(np.float32), np.array([b for _, b in models]))


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any alphabet."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~out):
        rest = raw[offsets[i] : offsets[i + 1]]
        if (rest > 127).any():
            out[i] = any(c.isalpha() for c in rest.tobytes().decode("utf-8", "ignore"))
    return out


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (doc_id), lang_pred and score of every row; only text is looked at. Columns named like the results are replaced."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    text = "text" if "text" in keep else "__text"
    picked = docs.select(*keep) if text in keep else docs.select(*keep, F.col("text").cast("string").alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in chunks(batch, text, rows=1024):
                lettered = has_letter(raw, offsets)
                if model is None:
                    langs, score = [None] * part.num_rows, np.zeros(part.num_rows)
                    lettered[:] = False
                else:
                    langs, score = model.predict(features(raw, offsets))
                langs = [lang if ok else "und" for lang, ok in zip(langs, lettered, strict=True)]
                score = np.where(lettered, score, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema[: len(keep)]]
    return picked.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n
