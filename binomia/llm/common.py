"""Helpers the corpus operators share: Arrow batches, word hashes, written tables, sized broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.session import shared_folder

#: Byte classes that separate words: the space and the bytes 09 to 0D. bytes.split() splits at the same six.
SEPARATORS = " \t\n\x0b\x0c\r"
_SEPARATOR_BYTES = [c.encode() for c in SEPARATORS]
#: Bytes of a text whose words are hashed at once.
BLOCK_BYTES = 1 << 18
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[[ord(c) for c in SEPARATORS]] = 0
_BYTE_VALUES = np.random.default_rng(2024).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0xD6E8FEB86659FD93
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def stash(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/binomia-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def needed(df: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads; whatever else the table carries cannot clash with its own names."""
    return df.select(*columns)


def fold(doc_id: Column) -> Column:
    """crc32 of the decimal id, modulo 4. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def least_hashes(df: DataFrame, place: Column, rows: int) -> DataFrame:
    """The rows of df with the `rows` least values of place, a 64-bit hash, and about as many more.

    An ordering with a limit sends its rows from every partition to the driver; after this cut, whose
    bound follows from the count, all partitions together hold few. Repeated values stay together.
    """
    n = df.count()
    if n <= 2 * rows:
        return df
    return df.filter(place < F.lit(-(2**63) + 2 * rows * 2**64 // n))


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[dict]], schema: str, rows: int = 256, start: Callable | None = None
) -> DataFrame:
    """Apply function to slices of at most `rows` rows; it returns dicts of equally long columns.

    `start`, if given, makes a value once per task that function gets as its second argument.
    """
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (start(),) if start else ()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in function(batch.slice(at, rows), *state):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        # the worker goes on to other tasks; what its batches took goes back to the machine
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def map_stream(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """Apply function to all batches of a partition in order; it returns dicts of equally long columns."""
    target = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in function(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order.

    A word is a run of bytes other than the six separators. Its hash is a polynomial over random values
    of its bytes, taken from running sums, so no word becomes a Python object. Long texts are read in
    blocks that end at separators.
    """
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > BLOCK_BYTES:
            cut = max(data.rfind(c, at, at + BLOCK_BYTES) for c in _SEPARATOR_BYTES)
            if cut < 0:
                later = [k for c in _SEPARATOR_BYTES if (k := data.find(c, at + BLOCK_BYTES)) >= 0]
                cut = min(later, default=len(data) - 1)
            end = cut + 1
        out.append(_block_hashes(np.frombuffer(data, np.uint8, end - at, at))[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def all_word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    """word_hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size + len(texts[end]) <= BLOCK_BYTES:
            size += len(texts[end]) + 1
            end += 1
        if end > at + 1:
            hashes, starts = _block_hashes(np.frombuffer(b"\n".join(texts[at:end]), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in texts[at:end]])
            out += np.split(hashes, np.searchsorted(starts, ends[:-1]))
        else:
            end = at + 1
            out.append(word_hashes(texts[at]))
        at = end
    return out


def _block_hashes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block."""
    inside = np.zeros(len(block) + 2, np.int8)
    inside[1:-1] = _IS_WORD[block]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers(len(block))
    with np.errstate(over="ignore"):
        total = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[block] * powers[: len(block)], out=total[1:])
        return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of them."""
    if len(_POWERS[0]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                row = np.full(size, base, np.uint64)
                row[0] = 1
                _POWERS[k] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of a public 64-bit hash)."""
    with np.errstate(over="ignore"):
        v = values ^ (values >> np.uint64(33))
        v *= np.uint64(0xFF51AFD7ED558CCD)
        v ^= v >> np.uint64(33)
        v *= np.uint64(0xC4CEB9FE1A85EC53)
        v ^= v >> np.uint64(33)
    return v


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, one for each start; a shorter text is one run, no words none."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mixed(out)


def components(links: DataFrame) -> DataFrame:
    """Connected components of (a, b) links: (id, component), the smallest id that is reachable.

    Every round takes the least label of the neighbours and then the label of that label, so chains
    shrink by halves; each round is written to the shared folder. Only the count of changes reaches
    the driver.
    """
    both = stash(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("far"))
        step = stash(
            lower.join(jump, "low", "left").select("id", F.least("low", F.coalesce("far", "low")).alias("component"), F.col("component").alias("was"))
        )
        changed = step.filter("component <> was").limit(1).count()
        labels = step.select("id", "component")
        if not changed:
            return labels


def filter_batches(df: DataFrame, keeps: Callable, start: Callable, rows: int = 256) -> DataFrame:
    """Rows of df for which keeps(texts, state) says so; all columns stay and nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield part.filter(pa.array(keeps(part.column("text").to_pylist(), state), pa.bool_()))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, df.schema)
