"""Language ID: averaged hashed subword embeddings with a linear softmax.

A word's features are the word and its character n-grams, hashed into a fixed number of rows; a text is
the mean of its features' vectors. The vectors and the softmax are trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows (`SAMPLE`), spread over the labels so that rare ones are
learned too. The features of whole sampled texts are counted in the tasks; only counts by hash row reach
the driver. A temperature and a rejection threshold are calibrated on a part of the sample held back
from training. For prediction vectors and softmax are
multiplied into one table of scores, so a text costs a lookup for each feature and label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binomia.llm.common import fold, map_batches, needed, word_hashes

#: Labelled rows that are learned from; their texts are read whole.
SAMPLE = 4000
#: Langs whose limits may be broadcast; those of more are joined by a shuffle.
BROADCAST_LANGS = 100_000
BUCKETS, DIMENSIONS, SIZES = 1 << 15, 16, (1, 2, 3, 4)
#: Share of the held-back rows whose score lies below the rejection threshold.
REJECTED = 0.01
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


#: Words whose features are worked out at once; longer texts are read in such blocks.
BLOCK_WORDS = 100_000
_SPACE, _SPREAD, _BITS = 32, np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - (BUCKETS - 1).bit_length())


def subwords(words: list[str]) -> np.ndarray:
    """Hash rows of the words and of their character n-grams, whose ends are marked by one space.

    The n-grams are read from the words laid out between single spaces; one with a space inside would
    reach into the next word and is left out.
    """
    line = " ".join(words)
    rows = [(word_hashes(line.encode("utf-8", "replace")) % np.uint64(BUCKETS)).astype(np.int32)]
    codes = np.frombuffer(f" {line} ".encode("utf-32-le", "replace"), "<u4")
    inner, grams = codes != _SPACE, codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in SIZES:
            if n > 1:
                grams = grams[:-1] * _SPREAD + codes[n - 1 :]
            whole = np.ones(max(len(codes) - n + 1, 0), bool)
            for k in range(1, n - 1):
                whole &= inner[k : k + len(whole)]
            rows.append((((grams[: len(whole)] + np.uint64(n)) * _SPREAD) >> _BITS).astype(np.int32)[whole])
    return np.concatenate(rows)


def blocks(text: str) -> list[list[str]]:
    words = text.lower().split()
    return [words[at : at + BLOCK_WORDS] for at in range(0, len(words), BLOCK_WORDS)]


@dataclass
class LanguageModel:
    """langs: sorted labels; table: scores by hash row and label; threshold: below it a text is rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


class Scorer:
    """Probabilities of texts."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.columns = [np.ascontiguousarray(c) for c in model.table.T]

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.columns)), 0
        for words in blocks(text):
            rows = subwords(words)
            total += [c.take(rows).sum(dtype=np.float64) for c in self.columns]
            n += len(rows)
        return (total / max(n, 1) + self.model.bias) / self.model.temperature

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, probability and whether the text is rejected."""
        if text is None or not self.model.langs or LETTER.search(text) is None:
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text))
        best = int(p.argmax())
        return self.model.langs[best], float(p[best]), bool(p[best] < self.model.threshold)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash rows of a text's features, ascending, and how often each occurs; at most BUCKETS of them."""
    total = np.zeros(BUCKETS, np.int64)
    for words in blocks(text):
        total += np.bincount(subwords(words), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found]


def fit_language(rows: list[tuple[str, str]], **settings) -> LanguageModel:
    """Train on (text, lang) rows."""
    return fit_counts([(*counted(text), lang) for text, lang in rows], **settings)


def fit_counts(
    rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 7
) -> LanguageModel:
    """Train on (hash rows, counts, lang); a fifth of each lang is held back for temperature and threshold."""
    langs = sorted({lang for *_, lang in rows})
    rng = np.random.default_rng(seed)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    features = [(f, n) for f, n, _ in rows]
    number = {lang: k for k, lang in enumerate(langs)}
    labels = np.array([number[lang] for *_, lang in rows])
    held, train, seen = [], [], np.zeros(len(langs), np.int64)
    for k in rng.permutation(len(rows)).tolist():
        if len(features[k][0]):
            seen[labels[k]] += 1
            (held if seen[labels[k]] % 5 == 0 else train).append(k)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    out, bias = np.zeros((DIMENSIONS, len(langs))), np.zeros(len(langs))
    steps, done = max(epochs * len(train), 1), 0
    for _ in range(epochs):
        order = rng.permutation(train) if train else []
        for at in range(0, len(order), batch):
            group = order[at : at + batch]
            pace = rate * (1 - done / steps)
            done += len(group)
            means = np.stack([n @ vectors[f] / n.sum() for f, n in (features[k] for k in group)])
            error = softmax(means @ out + bias)
            error[np.arange(len(group)), labels[group]] -= 1
            back = error @ out.T
            out -= pace * means.T @ error
            bias -= pace * 0.1 * error.sum(0)
            for k, g in zip(group, back, strict=True):
                f, n = features[k]
                vectors[f] -= np.outer(n, pace * g / n.sum() * 4)
    model = LanguageModel(langs, (vectors @ out).astype(np.float32), bias, 1.0, 0.0)
    checked = held or train
    if checked:
        logits = np.stack([n @ model.table[f] / n.sum() + bias for f, n in (features[k] for k in checked)])
        right = np.arange(len(checked)), labels[checked]
        loss = {t: -np.log(softmax(logits / t)[right] + 1e-12).mean() for t in (0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0)}
        model.temperature = min(loss, key=loss.get)
        model.threshold = float(np.quantile(softmax(logits / model.temperature).max(1), REJECTED))
    return model


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to take of each label: alike for all, but that what small labels leave goes to the larger ones."""
    out, left = {}, sample
    for at, (label, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        out[label] = min(n, max(left // (len(counts) - at), 1))
        left -= out[label]
    return out


def train_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """Fit on about `sample` rows outside the held-out fold, spread over the langs (one row of each at least).

    Of a lang the rows with the least hashes of their ids are taken, with the text's hash for repeated ids;
    rows that are equal in both count once. Only text and non-null lang are read, texts of any length as a
    whole. The driver gets the counts of features, at most BUCKETS for a row.
    """
    known = needed(docs, "doc_id", "text", "lang").filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64("doc_id").alias("place"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return fit_counts([])
    wanted = shares(counts, sample)
    # about twice the rows of each lang lie below its hash; those are ranked, which moves few of them
    below = {lang: 2**63 - 1 if n <= 2 * wanted[lang] else -(2**63) + 2 * wanted[lang] * 2**64 // n for lang, n in counts.items()}
    limits = docs.sparkSession.createDataFrame(
        [(lang, wanted[lang], below[lang]) for lang in sorted(counts)], "lang string, wanted int, below long"
    )
    if len(counts) <= BROADCAST_LANGS:
        limits = F.broadcast(limits)  # so only the rows that are ranked move
    order = Window.partitionBy("lang").orderBy("place", "mark")
    some = (
        known.join(limits, "lang")
        .filter(F.col("place") <= F.col("below"))
        .withColumn("mark", F.xxhash64("text"))
        .dropDuplicates(["lang", "place", "mark"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= F.col("wanted"))
        .select("lang", "text", "place", "mark")
    )

    def made(batch):
        found = [counted(v.as_py()) for v in batch.column("text")]
        yield {
            **{c: batch.column(c) for c in ("lang", "place", "mark")},
            "rows": [f.tobytes() for f, _ in found],
            "counts": [n.tobytes() for _, n in found],
        }

    rows = map_batches(some, made, "lang string, place long, mark long, rows binary, counts binary", rows=64).collect()
    rows.sort(key=lambda r: (r["place"], r["mark"], r["lang"]))
    return fit_counts([(np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.int64), r["lang"]) for r in rows])


def language_id(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """lang_pred, score and rejected for every row of docs (doc_id, text).

    lang_pred is a learned label, or `und` where the text is null, empty or without a letter (score 0,
    rejected). Whole texts are read; every row gives one row, repeated and null ids too; other columns
    are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession.sparkContext
    shared = spark.broadcast(model)  # BUCKETS x labels floats

    def predicted(batch, scorer):
        found = [scorer.predict(v.as_py()) for v in batch.column("text")]
        yield {
            "doc_id": batch.column("doc_id"),
            "lang_pred": [f[0] for f in found],
            "score": [f[1] for f in found],
            "rejected": [f[2] for f in found],
        }

    return map_batches(
        needed(docs, "doc_id", "text"), predicted, "doc_id long, lang_pred string, score double, rejected boolean", start=lambda: Scorer(shared.value)
    )
