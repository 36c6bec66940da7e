"""Codes of vectors: exact integer codebooks for eight parts, assigned through a Walsh-Hadamard transform.

Components become whole numbers and vectors are cut into equal parts. A part and the entries of its
codebook are padded with zeros to a power of two and transformed; the transform keeps squared distances up
to that power. Squared differences are added up coefficient by coefficient in sequency order, slow
ones first, and an entry is dropped as soon as its sum exceeds the whole distance of an entry already
known. All numbers are whole ones, so the outcome is exact: 64-bit ones where they surely suffice,
Python's own where components are huge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binomia.llm.common import needed, stash

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Coefficients looked at before the first entries are dropped, then between drops.
_STEP = 2
#: Labels whose sums are broadcast (24 bytes each); with more of them the join shuffles.
_SMALL_LABELS = 100_000


def sequency_order(size: int) -> np.ndarray:
    """Rows of the natural Hadamard matrix by number of sign changes: bit-reversed Gray codes."""
    bits = size.bit_length() - 1
    gray = np.arange(size) ^ (np.arange(size) >> 1)
    out = np.zeros(size, np.int64)
    for k in range(bits):
        out |= ((gray >> k) & 1) << (bits - 1 - k)
    return out


def transformed(parts: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows padded with zeros to a power of two, in sequency order."""
    width = parts.shape[1]
    size = 1 << max(width - 1, 0).bit_length()
    out = np.zeros((len(parts), size), parts.dtype)
    out[:, :width] = parts
    half = 1
    while half < size:
        pairs = out.reshape(len(parts), size // (2 * half), 2, half)
        out = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(len(parts), size)
        half *= 2
    return out[:, sequency_order(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part the least index of a nearest entry, and its squared distance."""
    rows, codes = transformed(parts), transformed(entries)
    n, size = rows.shape
    least = min(_STEP, size)
    sums = ((rows[:, None, :least] - codes[None, :, :least]) ** 2).sum(axis=2)
    # the whole distance of the entry that looks nearest bounds the least one
    first = sums.argmin(axis=1)
    bound = sums[np.arange(n), first] + ((rows[:, least:] - codes[first, least:]) ** 2).sum(axis=1)
    row, entry = np.nonzero(sums <= bound[:, None])
    kept = sums[row, entry]
    for at in range(least, size, _STEP):
        kept = kept + ((rows[row, at : at + _STEP] - codes[entry, at : at + _STEP]) ** 2).sum(axis=1)
        stays = kept <= bound[row]
        row, entry, kept = row[stays], entry[stays], kept[stays]
    # all that is left is at the least distance found so far or nearer; pairs run by row and then by entry
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    best = np.minimum.reduceat(kept, starts) if len(row) else kept
    hit = np.flatnonzero(kept == np.repeat(best, np.diff(np.append(starts, len(row)))))
    _, one = np.unique(row[hit], return_index=True)
    return entry[hit[one]], best // size


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly. Python integers where 64 bits might not hold a sum of squares."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    padded = 1 << max(vectors.shape[1] - 1, 0).bit_length()
    if len(scaled) and np.abs(scaled).max(initial=0) >= np.sqrt(2.0**60 / padded**3):
        return np.array([[int(x) for x in row] for row in scaled.tolist()], object).reshape(scaled.shape)
    return scaled.astype(np.int64)


class Coder:
    """Codebooks (parts x entries x places, Python integers) applied to batches of vectors."""

    def __init__(self, codebooks: list[list[list[int]]], width: int, scale: int = SCALE):
        self.codebooks, self.width, self.scale = codebooks, width, scale

    def parts(self, column: pa.ListArray) -> np.ndarray:
        """Rows x parts x places; shorter vectors end in zeros."""
        total = self.width * len(self.codebooks)
        sizes = np.diff(column.offsets.to_numpy())
        values = column.flatten().to_numpy(zero_copy_only=False)
        vectors = np.zeros((len(column), total))
        row = np.repeat(np.arange(len(column)), sizes)
        vectors[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
        return whole_numbers(vectors, self.scale).reshape(len(column), len(self.codebooks), self.width)

    def assign(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole-number parts, index of each part's entry, squared distance of each."""
        parts = self.parts(column)
        codes, errors = [], []
        for k, book in enumerate(self.codebooks):
            entries = np.array(book, object)
            small = parts.dtype != object and max((abs(int(x)) for e in book for x in e), default=0) ** 2 * (2 * self.width) ** 3 < 2**59
            code, error = nearest(parts[:, k] if small else parts[:, k].astype(object), entries.astype(np.int64) if small else entries)
            codes.append(code)
            errors.append(error)
        return parts, np.array(codes), np.array(errors)


def _sums(vectors: DataFrame, coder: Coder) -> list:
    """Count and component sums of the parts of each entry; one row for each part, entry and place reaches the driver."""
    places = coder.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(coder.codebooks), len(coder.codebooks[0]), places), object)
        count = np.zeros(total.shape[:2], np.int64)
        for batch in batches:
            parts, codes, _ = coder.assign(batch.column(0))
            for k in range(len(codes)):
                for e in np.unique(codes[k]):
                    mine = parts[codes[k] == e, k]
                    # 64-bit sums of one batch, added up as Python integers
                    total[k, e] += np.array([int(x) for x in mine.sum(axis=0)], object)
                    count[k, e] += len(mine)
        part, entry = np.nonzero(count)
        out = [(p, e, i, str(total[p, e, i]), count[p, e]) for p, e in zip(part.tolist(), entry.tolist(), strict=True) for i in range(places)]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "entry", "place", "total", "n"])

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    sums = vectors.select("embedding").mapInArrow(run, "part int, entry int, place int, total string, n long")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    return sums.groupBy("part", "entry", "place").agg(total.alias("total"), F.sum("n").alias("n")).collect()


def train_codebooks(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int, scale: int) -> list[list[list[int]]]:
    """Codebooks from the first entries by vec_id (nulls last, then by components) and some rounds of means."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).toArrow()
    blank = Coder([[]] * parts, width, scale)
    column = first.column("embedding").combine_chunks()
    start = blank.parts(column if isinstance(column, pa.ListArray) else pa.array([], pa.list_(pa.float64())))
    books = [[[int(x) for x in row[k]] for row in start] for k in range(parts)]
    for _ in range(rounds if books[0] else 0):
        for part, entry, place, total, n in _sums(vectors, Coder(books, width, scale)):
            books[part][entry][place] = int(total) // n
    return books


def vector_codes(
    embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of embeddings.

    embeddings has vec_id, embedding and label; other columns are ignored. Rows whose vector is null or
    holds a null or a component that isn't finite are left out. Vectors shorter than the longest, and
    all of them where the length isn't a multiple of the number of parts, end in zeros. Repeated rows
    stay; null ids stay null and start codebooks last. With fewer rows than entries the codebooks are
    smaller; an empty table gives an empty result. Null labels count together. A sum of squares beyond
    64 bits is null, and so is a label's sum that holds one.
    """
    rows = needed(embeddings, "vec_id", "embedding", "label")
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = rows.filter(usable)
    longest = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    coder = Coder(train_codebooks(vectors, width, parts, entries, rounds, scale), width, scale)
    digest = hashlib.sha256(",".join(str(x) for book in coder.codebooks for entry in book for x in entry).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, codes, errors = coder.assign(batch.column("embedding"))
            text = ["".join(f"{x:02x}" for x in row) for row in codes.T.tolist()]
            error = [x if x < 2**63 else None for x in errors.sum(axis=0).tolist()]
            arrays = [batch.column("vec_id"), pa.array(text, pa.string()), pa.array(error, pa.int64()), batch.column("label")]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "code", "error", "label"])

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    coded = stash(vectors.mapInArrow(run, f"vec_id {kind['vec_id']}, code string, error long, label {kind['label']}"))
    whole = F.count("error") == F.count(F.lit(1))
    sums = coded.groupBy("label").agg(F.when(whole, F.try_sum("error")).alias("label_error"))
    sums = sums.withColumnRenamed("label", "of_label")
    if sums.count() <= _SMALL_LABELS:
        sums = F.broadcast(sums)
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("of_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by comparing every part with every entry, for vectors of one length."""
    steps = [f"""kept AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(embedding)) // {parts} AS w FROM kept),
parts AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale}::DOUBLE * x) AS BIGINT)) AS v FROM kept),
cut AS (SELECT r, vec_id, p, v[p * w + 1 : (p + 1) * w] AS x FROM parts, width, range({parts}) AS t(p)),
book0 AS (SELECT p, n - 1 AS e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) AS n FROM cut) WHERE n <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (SELECT r, p, unnest(min_by(x, d, 1)) AS x, min(d)[1] AS d, min(d)[2] AS e FROM (
  SELECT r, cut.p, x, [list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e]::HUGEINT[] AS d
  FROM cut JOIN book{k} AS b ON cut.p = b.p) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (
  SELECT p, e, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
  FROM near{k}, width, range(1, w + 1) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""coded AS (SELECT r, string_agg(printf('%02x', e::BIGINT), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded JOIN parts USING (r), digest"""
