"""Language identification: averaged hashed subword embeddings and a linear
softmax, trained by stochastic gradient descent in numpy, with calibrated
rejection.

A text is the average of the embeddings of its character n-grams (hashed to
``buckets`` rows, n from 1 to 4, lower-cased, letters and single spaces only),
followed by a linear layer and a softmax.  Since all of it is linear up to the
softmax, a trained model is one table of a score per bucket and language.

The fit takes at most ``fit_rows`` labelled rows, those of the smallest
hash of the id, as sparse n-gram counts made by the tasks.  A fifth of them is kept out
of training to calibrate: a temperature is chosen by likelihood, then the
rejection threshold is the score below which only ``lost`` of the correctly
predicted rows lie (never above 1/2).

Defined cases: text that is null or has no letter is ``und`` with score 0, and rejected.  With
one language that is always the answer; without any labelled row every text
is ``und``.  Each row gives a row; whole texts are read; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchdata.llm.common import columns

FIT_ROWS = 4000
BUCKETS = 1 << 13
DIMS = 16
EPOCHS = 8
LOST = 0.001
SLICE = 1 << 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _letters(text: str) -> np.ndarray:
    """Code points, each run of characters other than letters as one space."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()) if not text.isascii() else text.lower()
    code = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (code >= 128) | ((code >= 97) & (code <= 122))
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, code, 32)[keep]


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, read in slices."""
    total = np.zeros(buckets, np.int64)
    for at in range(0, len(text), SLICE):
        code = np.concatenate([[32], _letters(text[max(0, at - 3) if at else 0:at + SLICE])]).astype(np.uint32)
        if len(code) < 2:
            continue
        h = np.zeros(len(code), np.uint32)
        for n in range(1, 5):
            if len(code) < n:
                break
            h = (h[:len(code) - n + 1] ^ code[n - 1:]) * _ODD[n - 1]
            h ^= h >> np.uint32(15)
            total += np.bincount(h % np.uint32(buckets), minlength=buckets)
    return total


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray            # buckets x langs: embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / np.maximum(counts.sum(-1, keepdims=True), 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected)."""
        if not self.langs or not has_letter(text):
            return "und", 0.0, True
        p = _softmax(self.logits(gram_counts(text, len(self.table)).astype(float)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], buckets: int = BUCKETS,
          dims: int = DIMS, epochs: int = EPOCHS, lost: float = LOST, seed: int = 11) -> Model:
    """Fit on (bucket numbers, counts) rows and their languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    keep = order[: len(rows) // 5]
    fit = order[len(keep):]
    emb = rng.normal(0, 1 / dims, (buckets, dims))
    out, bias = np.zeros((dims, len(names))), np.zeros(len(names))

    def dense(which: np.ndarray) -> np.ndarray:
        x = np.zeros((len(which), buckets))
        for i, r in enumerate(which):
            x[i, rows[r][0]] = rows[r][1]
        return x / np.maximum(x.sum(1, keepdims=True), 1)

    steps, done = epochs * -(-len(fit) // 64), 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(fit), -(-len(fit) // 64)):
            rate = 1 - done / steps
            done += 1
            x = dense(part)
            h = x @ emb
            g = (_softmax(h @ out + bias) - np.eye(len(names))[y[part]]) / len(part)
            back = x.T @ (g @ out.T)
            out -= 40 * rate * (h.T @ g)
            bias -= rate * g.sum(0)
            emb -= 40 * rate * back
    model = Model(names, emb @ out, bias)
    if len(keep):
        z = np.concatenate([model.logits(dense(p)) for p in np.array_split(keep, -(-len(keep) // 64))])
        grid = np.geomspace(0.05, 20, 61)
        likely = [np.log(np.maximum(_softmax(z / t)[np.arange(len(keep)), y[keep]], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmax(likely))])
        p = _softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[keep]]
        if len(right):
            model.threshold = min(0.5, float(np.quantile(right, lost)))
    return model


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """A model from rows of (doc_id, text, lang) that aren't held out."""
    usable = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                          F.col("lang").cast("string").alias("lang"))
              .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))))
    order = F.xxhash64("doc_id")
    n = usable.count()
    if n > fit_rows:      # ids whose hash falls in the lowest share: about fit_rows of them
        usable = usable.where(order < int(-(1 << 63) + (1 << 64) * (0.9 * fit_rows / n)))
    schema = pa.schema([("rank", pa.int64()), ("lang", pa.string()), ("grams", pa.binary()), ("counts", pa.binary())])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ranks, texts, langs in columns(batches, "rank", "text", "lang"):
            got = [(r, g, *_sparse(gram_counts(t, buckets))) for r, t, g in zip(ranks, texts, langs, strict=True)
                   if has_letter(t)]
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in
                                   zip(zip(*got, strict=True) if got else [[]] * 4, schema, strict=True)],
                                  schema=schema)

    rows = (usable.select(order.alias("rank"), "text", "lang")
            .mapInArrow(sparse, "rank long, lang string, grams binary, counts binary")
            .orderBy("rank", "lang", "grams", "counts").limit(fit_rows).collect())
    return train([(np.frombuffer(r["grams"], "<u2"), np.frombuffer(r["counts"], "<u2")) for r in rows],
                 [r["lang"] for r in rows], buckets)


def _sparse(counts: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(counts)
    return at.astype("<u2").tobytes(), np.minimum(counts[at], 65535).astype("<u2").tobytes()


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` as ``row`` with ``lang_pred``, ``score`` and
    ``rejected`` beside it.  One pass, no shuffle."""
    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[1] for g in got], pa.float64()),
                                   pa.array([g[2] for g in got], pa.bool_())],
                                  names=["row", "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return (docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
            .mapInArrow(predicted, schema))
