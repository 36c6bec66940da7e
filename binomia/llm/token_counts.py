"""Token counts: pieces are counted once per distinct pre-token and summed by document.

A chunk of documents keeps the frequencies of its pre-tokens as indexes into the chunk's own word
list. Only these lists travel: they are dealt out and sorted by pre-token, whose pieces are counted once,
and the counts are joined back to the chunks and multiplied with the frequencies. No ids are kept anywhere. A common pre-token
occurs once per chunk, so no key of the join is hot.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import map_batches, needed, stash
from binomia.llm.pretokens import pieces

#: Most documents whose frequencies share one word list; a batch of the scan may hold fewer.
CHUNK_ROWS = 10_000


def packed(values: np.ndarray) -> bytes:
    """Small numbers, compressed byte plane by byte plane."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Chunks:
    """Frequencies of one task's documents, chunk by chunk."""

    def __init__(self, path: str):
        self.pieces, self.made = pieces(path), 0

    def table(self, batch) -> dict:
        place: dict[str, int] = defaultdict(lambda: len(place))
        sizes, index, freq, added, n_bytes = [], [], [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            found, n_added = [], 0
            for k, part in enumerate(self.pieces.parts(text)):
                if k % 2:
                    n_added += 1
                elif part:
                    found += map(place.__getitem__, self.pieces.units(part))
            where, count = np.unique(np.array(found, np.int32), return_counts=True)
            index.append(np.diff(where, prepend=np.int32(0)))
            freq.append(count.astype(np.int32))
            sizes.append(len(where))
            added.append(n_added)
            n_bytes.append(len(text.encode()))
        self.made += 1
        context = TaskContext.get()
        return {
            "chunk": [((context.partitionId() if context else 0) << 32) + self.made],
            "doc_id": [batch.column("doc_id").to_pylist()],
            "n_bytes": [n_bytes],
            "added": [added],
            "sizes": [sizes],
            "steps": [packed(np.concatenate(index))],
            "freq": [packed(np.concatenate(freq))],
            "words": [list(place)],
        }


def _counted(batch, library):
    """The piece counts of a batch of sorted (word, chunk, place), packed chunk by chunk as places and counts."""
    words = batch.column("word").dictionary_encode()
    n = np.array([len(x) for x in library.encode(words.dictionary.to_pylist())], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
    chunk, place = batch.column("chunk").to_numpy(), batch.column("place").to_numpy()
    order = np.lexsort((place, chunk))
    chunk, place, n = chunk[order], place[order].astype(np.int64), n[order]
    firsts = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
    rows = zip(np.split(place, firsts[1:]), np.split(n, firsts[1:]), strict=True)
    yield {"chunk": chunk[firsts], "part": [packed(np.concatenate(r)) for r in rows]}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text).

    path: a file of the tokenizers library. Null and empty texts have no tokens; every row, also a
    repeated one or one with a null id, gives one row; other columns are ignored; an empty table gives
    an empty one. Special strings inside a text are one token each, as the library's default has it.
    """
    chunks = stash(
        map_batches(
            needed(docs, "doc_id", "text"),
            lambda batch, state: [state.table(batch)],
            "chunk long, doc_id array<long>, n_bytes array<long>, added array<int>, sizes array<int>, steps binary, freq binary, words array<string>",
            rows=chunk_rows,
            start=lambda: _Chunks(path),
        )
    )
    # equal words are dealt to one task and lie next to each other there, at most one for each chunk
    listed = chunks.select("chunk", F.posexplode("words").alias("place", "word")).repartition("word").sortWithinPartitions("word")
    counts = (
        map_batches(listed.select("word", "chunk", "place"), _counted, "chunk long, part binary", rows=1 << 20, start=lambda: pieces(path))
        .groupBy("chunk")
        .agg(F.collect_list("part").alias("parts"))
    )

    def summed(batch):
        for row in range(batch.num_rows):
            at = {c: batch.column(c)[row].values for c in ("doc_id", "n_bytes", "added", "sizes")}
            sizes = np.array(at["sizes"])
            ends = np.cumsum(sizes)
            steps, freq = (unpacked(batch.column(c)[row].as_py()) for c in ("steps", "freq"))
            # the steps begin anew with every document
            index = np.cumsum(steps)
            index -= np.repeat(np.concatenate([[0], index])[ends - sizes], sizes)
            parts = batch.column("parts")[row].as_py() or []
            places, known = (np.concatenate([np.zeros(0, np.int64), *(unpacked(p).reshape(2, -1)[k] for p in parts)]) for k in (0, 1))
            n = np.zeros(len(places), np.int64)
            n[places] = known
            total = np.concatenate([[0], np.cumsum(n[index] * freq)])
            tokens = total[ends] - total[ends - sizes] + np.array(at["added"])
            yield {"doc_id": at["doc_id"], "n_bytes": at["n_bytes"], "n_tokens": tokens, "over_limit": tokens > limit}

    return map_batches(
        chunks.drop("words").join(counts, "chunk", "left"), summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", rows=2
    )
