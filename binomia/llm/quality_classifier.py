"""Quality classifier: how much better a text compresses with a dictionary of good texts than of bad ones.

Two zstandard dictionaries are trained on pieces from hashed places all over the texts of a bounded sample
of labelled rows (`SAMPLE`), a few pieces of each text. A text is compressed in blocks, so a dictionary
matters all along, once with each; the difference of the compressed sizes, divided by their sum, and the
sizes against the plain length become a score by a logistic curve, fitted on rows that the dictionaries
have not seen, whose whole texts are measured in the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import fold, least_hashes, map_batches, mixed, needed

#: Labelled rows of each quality to learn from; half of them make the dictionaries, half fit the curve.
SAMPLE = 1200
#: Pieces that a text gives to its dictionary, and their bytes. They lie anywhere in the text.
PIECES, PIECE_BYTES = 8, 512
DICTIONARY_BYTES, BLOCK, LEVEL = 96 << 10, 4096, 3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray  # of the measures and 1


class Measure:
    """Compressed-size measures of texts with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = [self._with(good), self._with(bad)]

    @staticmethod
    def _with(content: bytes):
        options = {"level": LEVEL, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        if len(content) < 8:
            return zstandard.ZstdCompressor(**options).compress
        data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_AUTO)
        data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=data, **options).compress

    def of(self, text: str) -> np.ndarray:
        data = text.encode()
        if not data:
            return np.array([0.0, 0.0, 0.0, 1.0])
        good = bad = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            good += len(self.compress[0](block))
            bad += len(self.compress[1](block))
        lasting = len(data) / (len(data) + 100)  # a short text says little
        return np.array([lasting * (bad - good) / (good + bad), lasting * (good / len(data) - 0.35), lasting * (bad / len(data) - 0.35), 1.0])


def pieces(text: str, seed: int) -> list[bytes]:
    """The pieces of a text with the least hashes of their numbers; short texts are given whole."""
    data = text.encode()
    n = -(-len(data) // PIECE_BYTES)
    chosen = np.arange(n)
    if n > PIECES:
        chosen = np.sort(np.argsort(mixed(np.arange(1, n + 1, dtype=np.uint64) ^ np.uint64(seed % 2**64)))[:PIECES])
    return [data[k * PIECE_BYTES : (k + 1) * PIECE_BYTES] for k in chosen.tolist()]


def dictionary(samples: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where the samples are too few to train on, their own bytes, evenly from all."""
    size = sum(map(len, samples))
    if size >= 8 * dictionary_bytes:
        try:
            return zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # samples that are all alike
    share = max(dictionary_bytes // max(len(samples), 1), 1)
    return b"\n".join(x[:share] for x in samples) if size > dictionary_bytes else b"\n".join(samples)


def fit_curve(good: bytes, bad: bytes, y: np.ndarray, x: np.ndarray) -> QualityModel:
    """The logistic curve of measures x of rows with labels y."""
    scale = np.concatenate([x[:, :-1].std(0) + 1e-9, [1.0]])
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-z @ w))
        ridge = np.array([1e-2] * (len(w) - 1) + [1e-6]) * len(y)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(good, bad, w / scale)


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fit on at most `sample` labelled rows of each quality outside the held-out fold; other columns play no part.

    Rows are taken by a hash of their id, every second one for the dictionaries. A document whose labels
    contradict each other is not learned from; of texts with one id that with the least hash counts. The
    share of good rows among all those learnable is counted and put into the curve's constant, as the
    sample holds both labels alike. Without texts of both labels every score is 0.5.
    """
    marked = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 2))
    known = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter("quality = most").select("doc_id", "quality")
    share = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    place, chosen = F.xxhash64("doc_id"), None
    for quality in (0, 1):
        some = least_hashes(known.filter(F.col("quality") == quality), place, sample).orderBy(place, "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionAll(some)
    # at most 2 * sample rows; the lowest bit of the hash deals them to dictionaries and curve
    chosen = chosen.withColumn("fits", place.bitwiseAND(1) == 1)
    texts = needed(docs, "doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    texts = texts.withColumn("mark", F.xxhash64("text"))

    def cut(batch):
        found = [pieces(v.as_py(), m) for v, m in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True)]
        yield {**{c: batch.column(c) for c in ("quality", "doc_id", "mark")}, "pieces": found}

    def one_each(rows: DataFrame, value: str):
        best = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", value), "mark").alias("row")).select("doc_id", "row.*")
        return sorted(best.collect(), key=lambda r: (r["quality"], r["doc_id"]))

    parts = map_batches(texts.filter("not fits"), cut, "quality int, doc_id long, mark long, pieces array<binary>")
    both: tuple[list[bytes], list[bytes]] = ([], [])
    for row in one_each(parts, "pieces"):
        both[row["quality"]].extend(bytes(p) for p in row["pieces"])
    bad, good = map(dictionary, both)
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))  # two dictionaries of DICTIONARY_BYTES

    def measured(batch, measure):
        yield {**{c: batch.column(c) for c in ("quality", "doc_id", "mark")}, "x": [measure.of(v.as_py()) for v in batch.column("text")]}

    x = map_batches(texts.filter("fits"), measured, "quality int, doc_id long, mark long, x array<double>", start=lambda: Measure(*shared.value))
    rows = one_each(x, "x")
    n = [sum(r["quality"] == q for r in rows) for q in (0, 1)]
    if not min(n) or not both[0] or not both[1]:
        return QualityModel(b"", b"", np.zeros(4))
    model = fit_curve(good, bad, np.array([r["quality"] for r in rows], float), np.array([r["x"] for r in rows]))
    model.weights[-1] += np.log(share[1] / share[0]) - np.log(n[1] / n[0])
    return model


def quality_scores(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """score (0 to 1, higher is better) and predicted for every row of docs (doc_id, text).

    Whole texts are compressed; null and empty texts get the curve's constant. Every row gives one row,
    repeated and null ids too; other columns are ignored; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY_BYTES

    def scored(batch, measure):
        x = np.stack([measure.of(v.as_py() or "") for v in batch.column("text")])
        score = 1 / (1 + np.exp(-np.clip(x @ shared.value.weights, -50, 50)))
        yield {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= threshold).astype(np.int32)}

    return map_batches(
        needed(docs, "doc_id", "text"), scored, "doc_id long, score double, predicted int", start=lambda: Measure(shared.value.good, shared.value.bad)
    )
