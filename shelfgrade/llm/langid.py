"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is lower-cased and read as UTF-8 with a blank at both ends. Its subwords are all runs of 2
to 4 bytes, hashed into ``BUCKETS`` slots. The text's vector is the average of the slots'
embeddings; a linear softmax on it gives the languages. Embeddings and softmax are trained together
by stochastic gradient descent in numpy.

Bounded sample: the model is fitted on at most ``sample`` different labelled texts, those with the
smallest hashes. Workers turn them into slot counts; the driver sees at most ``sample`` sparse
vectors of at most ``BUCKETS`` entries. A fifth of them does not train but calibrates: a
temperature for the probabilities, and the score below which a prediction is rejected: the ``loss`` quantile of the
calibration scores, so that at most ``loss`` of the calibration texts would be lost. Up to 1 / ``loss`` calibration texts this is
their lowest score, and of other texts of the learned languages about one in as many as calibrate falls below it. With fewer than
50 training texts none calibrates, and with one language all scores are 1; then only texts without letters are rejected.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is rejected.
Nulls among the labels and texts do not train. Repeated texts train once, under their smallest
label. Without any labelled text all predictions are ``und``. Very long texts are counted in full,
in blocks. Ties between languages go to the first by name. Other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BITS, SIZES, DIM, BLOCK = 14, (2, 3, 4), 16, 1 << 20
BUCKETS = 1 << BITS


def slot_counts(text: str) -> np.ndarray:
    """How often each slot's subwords occur in the text."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    tail = max(SIZES) - 1
    for at in range(0, len(raw), BLOCK):
        b = raw[at: at + BLOCK + tail].astype(np.uint32)
        h = b
        for n in range(2, max(SIZES) + 1):
            h = h[:-1] * np.uint32(0x01000193) + b[n - 1:]
            own = h[:BLOCK]
            out += np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS), minlength=BUCKETS)
            if len(h) < 2:
                break
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    """``folded`` is embeddings times softmax weights: the average of its rows gives the logits."""

    languages: list[str]
    folded: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    notes: dict = field(default_factory=dict)

    def logits(self, counts: np.ndarray) -> np.ndarray:
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        return counts.astype(np.float64) @ self.folded / total + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        z = self.logits(counts) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _sparse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        slots, counts = [], []
        for t in pdf["text"]:
            c = slot_counts(t)
            at = np.flatnonzero(c)
            slots.append(at.astype(np.int32))
            counts.append(c[at])
        yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "slots": slots, "counts": counts})


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 2000, epochs: int = 12,
          seed: int = 5, loss: float = 0.001) -> Model:
    """Fit on a bounded sample of the labelled rows; see the module's text."""
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    known = known.withColumn("h", F.xxhash64(F.lit(seed), "text"))
    smallest = known.groupBy("h").agg(F.lit(1).alias("one")).select("h").orderBy("h").limit(sample)
    top = smallest.agg(F.max("h").alias("h")).first()["h"]
    if top is None:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    picked = known.filter(F.col("h") <= top).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("x")).select("h", "x.lang", "x.text")
    got = picked.mapInPandas(_sparse, "h long, lang string, slots array<int>, counts array<long>").toArrow().combine_chunks()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    langs = got.column("lang").to_pylist()
    return fit([langs[i] for i in order], _views(got.column("slots"), order), _views(got.column("counts"), order), epochs, seed, loss)


def _views(column, order: np.ndarray) -> list[np.ndarray]:
    """The rows of a list column in the given order, as views of its one buffer."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if hasattr(lists, "chunk") else lists
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    return [flat[ends[i]: ends[i + 1]] for i in order]


def fit(langs: list[str], slots: list[np.ndarray], counts: list[np.ndarray], epochs: int, seed: int, loss: float) -> Model:
    """Stochastic gradient descent over sparse slot counts."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold = order[: len(y) // 5] if len(y) >= 50 else order[:0]
    own = order[len(hold):]
    e = (rng.standard_normal((BUCKETS, DIM)) / np.sqrt(DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, r in enumerate(rows):
            if len(slots[r]):
                x[i, slots[r]] = counts[r] / counts[r].sum()
        return x

    size = 32
    steps, done = max(1, epochs * ((len(own) + size - 1) // size)), 0
    for _ in range(epochs):
        mixed = rng.permutation(own)
        for at in range(0, len(mixed), size):
            rows = mixed[at: at + size]
            x = dense(rows)
            hidden = x @ e
            z = hidden @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            rate = np.float32(1 - done / steps)
            back = p @ w.T
            w -= 20 * rate * (hidden.T @ p)
            bias -= rate * p.sum(axis=0)
            hit = np.flatnonzero(x.any(axis=0))
            e[hit] -= 200 * rate * (x[:, hit].T @ back)
            done += 1
    # In double precision: scores near 1 must not all become 1.
    model = Model(languages, (e @ w).astype(np.float64), bias.astype(np.float64))
    if len(hold):
        def counted(rows: np.ndarray) -> np.ndarray:
            x = np.zeros((len(rows), BUCKETS), np.int64)
            for i, r in enumerate(rows):
                x[i, slots[r]] = counts[r]
            return x

        total = np.concatenate([model.logits(counted(hold[k: k + size])) for k in range(0, len(hold), size)])
        best = np.inf
        for t in np.geomspace(0.05, 20, 60):
            z = total / t
            z = z - z.max(axis=1, keepdims=True)
            nll = float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(hold)), y[hold]]).mean())
            if nll < best:
                best, model.temperature = nll, float(t)
        z = total / model.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        top = (p / p.sum(axis=1, keepdims=True)).max(axis=1)
        # Matrix products of other shapes may differ in the last bits.
        model.reject_below = float(np.sort(top)[int(loss * len(top))]) * (1 - 1e-12)
        model.notes = {"calibration_texts": len(hold), "accuracy": float(((p.argmax(axis=1)) == y[hold]).mean())}
    return model


def predict(texts: pd.Series, model: Model) -> pd.DataFrame:
    lang, score = ["und"] * len(texts), np.zeros(len(texts))
    for at in range(0, len(texts), 64):
        rows = [i for i in range(at, min(at + 64, len(texts))) if isinstance(texts.iat[i], str) and has_letter(texts.iat[i])]
        if rows and model.languages:
            p = model.probabilities(np.stack([slot_counts(texts.iat[i]) for i in rows]))
            for i, best, s in zip(rows, p.argmax(axis=1), p.max(axis=1)):
                lang[i], score[i] = model.languages[best], min(1.0, float(s))
    rejected = [x == "und" or s < model.reject_below for x, s in zip(lang, score)]
    return pd.DataFrame({"lang": lang, "score": score, "rejected": rejected})


def identify(text: Column, model: Model) -> Column:
    """Struct ``(lang, score, rejected)`` of a text column. The model (two megabytes at 16 languages) goes with the function."""
    @F.pandas_udf("lang string, score double, rejected boolean")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield predict(s, model)

    return run(text)
