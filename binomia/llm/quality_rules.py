"""Quality rules: a linear-chain conditional random field marks lines as content or boilerplate.

Every line gets a feature vector of shares of byte classes, of repeated words and of its form. Viterbi
decoding of the chain over a document's lines marks each as content or boilerplate, and the share of
content among the document's characters decides. The weights are fitted on the driver by gradient
ascent on the conditional likelihood, on a bounded sample of labelled documents (`SAMPLE`) of any length:
lines take their document's label, repeated ones count as boilerplate. The tasks read the whole texts; the
driver gets feature vectors of runs of lines from all over a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import SEPARATORS, fold, least_hashes, map_batches, mixed, needed, shingles, word_hashes

#: Labelled documents of each label that the weights are fitted on.
SAMPLE = 400
#: Chains are fitted in runs of so many lines, and so many runs of a document, which lie anywhere in it;
#: decoding takes whole documents.
CHAIN_LINES, RUNS = 64, 8
#: Share of the characters on content lines that keeps a document.
CONTENT_SHARE = 0.5
SYMBOLS = "#*$%&|<>"

# byte classes of the line features
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP = range(7)
_CLASS = np.zeros(256, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[128:] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[ord(c) for c in SEPARATORS]] = _SPACE
_CLASS[[ord(c) for c in SYMBOLS]] = _SYMBOL
_CLASS[[ord(c) for c in "!?@_=+~^\\{}[]"]] = _SYMBOL
_CLASS[[ord(c) for c in ".,;:"]] = _STOP
_N_CLASSES = 7
FEATURES = 14


@dataclass
class Chain:
    """Weights (FEATURES x 2) and transitions (2 x 2) of the chain; label 1 is content."""

    weights: np.ndarray
    moves: np.ndarray

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The most likely labels of one document's lines (Viterbi)."""
        score = features @ self.weights
        (s0, s1), back = score[0], np.zeros((len(score), 2), np.int8)
        (m00, m01), (m10, m11) = self.moves
        for t, (e0, e1) in enumerate(score[1:].tolist(), 1):
            a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back[t] = b > a, d > c
            s0, s1 = e0 + max(a, b), e1 + max(c, d)
        labels = np.zeros(len(score), np.int8)
        labels[-1] = s1 > s0
        for t in range(len(score) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels


class Reader:
    """What the rules count in a text and the feature vectors of its lines."""

    def read(self, text: str) -> tuple[dict, np.ndarray, np.ndarray]:
        """Counts; features of the lines that hold a word; their lengths in characters of words."""
        whole = text.encode()
        lines = whole.split(b"\n")
        words = [line.split() for line in lines]
        filled = [k for k, w in enumerate(words) if w]
        sizes = np.array([len(words[k]) for k in filled], np.int64)
        ids = word_hashes(whole)
        n = len(ids)
        seen, dup = set(), np.zeros(len(filled), bool)
        for at, k in enumerate(filled):
            dup[at] = lines[k] in seen
            seen.add(lines[k])
        repeated = np.zeros(n, bool)
        if n >= 5:
            windows = shingles(ids, 5)
            order = np.argsort(windows, kind="stable")
            same = windows[order[1:]] == windows[order[:-1]]
            twice = np.zeros(len(windows), bool)
            twice[order[1:]] |= same
            twice[order[:-1]] |= same
            steps = np.zeros(n + 1, np.int64)
            np.add.at(steps, np.flatnonzero(twice), 1)
            np.add.at(steps, np.flatnonzero(twice) + 5, -1)
            repeated = np.cumsum(steps[:-1]) > 0
        counts = {
            "n_words": n,
            "word_chars": len(text) - sum(map(text.count, SEPARATORS)),
            "n_symbols": sum(map(text.count, SYMBOLS)),
            "n_dup_lines": int(dup.sum()),
            "n_repeat_words": int(repeated.sum()),
        }
        if not n:
            return counts, np.zeros((0, FEATURES)), np.zeros(0)
        data = np.frombuffer(b"".join(lines[k] for k in filled), np.uint8)
        lengths = np.array([len(lines[k]) for k in filled], np.int64)
        line = np.repeat(np.arange(len(filled)), lengths)
        table = np.bincount(line * _N_CLASSES + _CLASS[data], minlength=len(filled) * _N_CLASSES).reshape(-1, _N_CLASSES)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        again = np.zeros(n, bool)
        again[1:] = ids[1:] == ids[:-1]
        visible = np.maximum(lengths - table[:, _SPACE], 1)
        features = np.zeros((len(filled), FEATURES))
        features[:, 0] = 1
        features[:, 1:6] = table[:, [_LOWER, _UPPER, _DIGIT, _SYMBOL, _STOP]] / visible[:, None]
        features[:, 6] = np.add.reduceat(repeated.astype(float), first) / sizes
        features[:, 7] = np.add.reduceat(again.astype(float), first) / sizes
        features[:, 8] = dup
        features[:, 9] = np.minimum(visible / sizes, 20) / 20
        features[:, 10] = np.minimum(np.log1p(sizes), 6) / 6
        features[:, 11] = features[:, 2] > 0.5
        features[:, 12] = features[:, 4] > 0.1
        features[:, 13] = sizes < 4
        return counts, features, visible.astype(float)


def fit_chain(documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Fit weights and transitions to (features, labels) of documents by full-batch gradient ascent.

    The chains are padded to one length; forward and backward passes run over all of them at once.
    """
    weights, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    documents = [d for d in documents if len(d[1])]
    if len({int(y) for _, ys in documents for y in ys}) < 2:
        weights[0] = [0.0, 1.0]
        return Chain(weights, moves)
    n, longest = len(documents), max(len(y) for _, y in documents)
    x, y, mask = np.zeros((n, longest, FEATURES)), np.zeros((n, longest), np.int64), np.zeros((n, longest))
    for k, (features, labels) in enumerate(documents):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = features, labels, 1
    hot = np.eye(2)[y] * mask[:, :, None]
    share = hot.sum((0, 1)) / mask.sum()
    balance = (0.5 / np.maximum(share, 0.05))[y[:, 0]]  # both labels weigh the same
    pair_hot = (hot[:, :-1, :, None] * hot[:, 1:, None, :] * balance[:, None, None, None]).sum((0, 1))
    want = np.einsum("ntf,ntk,n->fk", x, hot, balance)
    total = (mask * balance[:, None]).sum()
    speed = [np.zeros_like(weights), np.zeros_like(moves)]
    for _ in range(rounds):
        score = x @ weights
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, step, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(moves + (score[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, step, 0)
        norm = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + backward - norm[:, None, None]) * mask[:, :, None] * balance[:, None, None]
        pair = np.exp(forward[:, :-1, :, None] + moves + (score + backward)[:, 1:, None, :] - norm[:, None, None, None])
        pair = (pair * (mask[:, 1:] * balance[:, None])[:, :, None, None]).sum((0, 1))
        up = (want - np.einsum("ntf,ntk->fk", x, single)) / total - decay * weights, (pair_hot - pair) / total - decay * moves
        for k, value in enumerate((weights, moves)):
            speed[k] = 0.9 * speed[k] + up[k]
            value += rate * speed[k]
    return Chain(weights, moves)


def train_chain(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most `sample` labelled documents of each quality, of any length.

    Only rows outside the held-out fold are looked at. A document whose labels contradict each other is
    not learned from; of texts with one id that with the least hash counts. Ties of the sampling order are
    broken by id. A document gives its runs of lines with the least hashes of their numbers, at most RUNS.
    Without any labelled text every line counts as content.
    """
    marked = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 2))
    known = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    known = known.filter("quality = most").select("doc_id", "quality")
    place, chosen = F.xxhash64("doc_id"), None
    for quality in (0, 1):
        some = least_hashes(known.filter(F.col("quality") == quality), place, sample).orderBy(place, "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionAll(some)
    texts = needed(docs, "doc_id", "text").filter(F.col("text").isNotNull())
    texts = texts.join(F.broadcast(chosen), "doc_id").withColumn("mark", F.xxhash64("text"))  # at most 2 * sample rows

    def read(batch, reader):
        runs = []
        for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True):
            _, features, _ = reader.read(text.as_py())
            starts = np.arange(0, len(features), CHAIN_LINES)
            if len(starts) > RUNS:
                order = np.argsort(mixed(np.arange(1, len(starts) + 1, dtype=np.uint64) ^ np.uint64(mark % 2**64)))
                starts = np.sort(starts[order[:RUNS]])
            runs.append([features[at : at + CHAIN_LINES].tobytes() for at in starts.tolist()])
        yield {**{c: batch.column(c) for c in ("quality", "doc_id", "mark")}, "runs": runs}

    found = map_batches(texts, read, "quality int, doc_id long, mark long, runs array<binary>", start=Reader)
    rows = found.groupBy("doc_id").agg(F.min_by(F.struct("quality", "runs"), "mark").alias("row")).select("doc_id", "row.*").collect()
    documents = []
    for row in sorted(rows, key=lambda r: (r["quality"], r["doc_id"])):
        for run in row["runs"]:
            features = np.frombuffer(bytes(run)).reshape(-1, FEATURES)
            documents.append((features, np.where(features[:, 8] > 0, 0, row["quality"]).astype(np.int64)))
    return fit_chain(documents)


def verdict(reader: Reader, chain: Chain, text: str | None, content_share: float = CONTENT_SHARE) -> dict:
    """The counts of a text, base_failed, its share of content and whether it is kept."""
    counts, features, lengths = reader.read(text or "")
    failed = counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]
    share = float(lengths @ chain.decode(features) / lengths.sum()) if len(lengths) else 0.0
    return {**counts, "base_failed": failed, "kept": not failed and share >= content_share, "content_share": share}


def quality_rules(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, base_failed, content share and verdict of every row of docs (doc_id, text).

    Null and empty texts have no words and fail the base rules. Every row gives one row, repeated ids
    and null ids too; other columns are ignored; an empty table gives an empty one. Texts of any length
    are read whole.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def judged(batch, reader):
        found = [verdict(reader, chain, v.as_py(), content_share) for v in batch.column("text")]
        yield {"doc_id": batch.column("doc_id"), **{n: [f[n] for f in found] for n in (*names, "base_failed", "kept", "content_share")}}

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double"
    return map_batches(needed(docs, "doc_id", "text"), judged, schema, start=Reader)
