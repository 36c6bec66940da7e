"""Files of token ids: written in ascending order of the documents, read back in parallel.

A folder holds one file for each range of documents and a table `manifest` of its files. A file is
a run of groups of blocks (see mixing_coder), then the ids and lengths of its documents, then where those
start. Blocks are coded and checked by themselves; a document may span several blocks of its file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.common import map_batches, needed
from binomia.llm.mixing_coder import BLOCK_IDS, GROUP_BLOCKS, Damaged, decode_group, encode_group
from binomia.llm.token_ids import ids_of_file, with_ends
from binomia.session import shared_folder

#: Bytes of text that a file takes, counting some for every row, and rows tokenized at once.
FILE_BYTES, ROW_BYTES, BATCH_ROWS = 64 << 20, 64, 256
_MAGIC = b"MIXIDS01"
_GROUP_IDS = BLOCK_IDS * GROUP_BLOCKS
MANIFEST = "part int, file string, start long, n_docs long, n_ids long, n_bytes long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: a local path, or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(folder)


class _Writer:
    """Writes one file; ids wait until they fill a group."""

    def __init__(self, stream):
        self.stream, self.waiting, self.n_waiting = stream, [], 0
        self.doc_ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.n_ids = 0
        stream.write(_MAGIC)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.sizes.append(sizes)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        # half a group more waits, so that no file ends in a small group: each costs as many steps as a full one
        if self.n_waiting >= 3 * _GROUP_IDS // 2:
            ids = np.concatenate(self.waiting)
            while len(ids) >= 3 * _GROUP_IDS // 2:
                self.group(ids[:_GROUP_IDS])
                ids = ids[_GROUP_IDS:]
            self.waiting, self.n_waiting = [ids.copy()], len(ids)

    def group(self, ids: np.ndarray) -> None:
        blocks = encode_group(ids)
        self.stream.write(np.array([len(blocks), *(x for n, data in blocks for x in (n, len(data)))], "<u4").tobytes())
        for _, data in blocks:
            self.stream.write(data)

    def close(self) -> None:
        if self.n_waiting:
            self.group(np.concatenate(self.waiting))
        at = self.stream.tell()
        names = np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
        known = np.array([d is not None for d in self.doc_ids], np.uint8).tobytes()
        sizes = np.concatenate([*self.sizes, np.zeros(0, np.int64)]).astype("<i8").tobytes()
        index = names + known + sizes
        self.stream.write(index + np.array([at, len(self.doc_ids), zlib.crc32(index)], "<u8").tobytes() + _MAGIC)


def read_file(source) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, number of ids, parts of the ids) of each document of an open file, in order.

    One group is held at a time. Damaged is raised for a block or an index whose check value is wrong.
    """
    size = source.size()
    source.seek(size - 32)
    tail = source.read(32)
    at, n, check = (int(x) for x in np.frombuffer(tail[:24], "<u8"))
    if tail[24:] != _MAGIC or at + 17 * n + 32 != size:
        raise Damaged("not a whole file of token ids")
    source.seek(at)
    index = source.read(17 * n)
    if zlib.crc32(index) != check:
        raise Damaged("the list of documents fails its check value")
    names, known, sizes = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n), np.frombuffer(index, "<i8", n, 9 * n)
    source.seek(len(_MAGIC))
    ids, parts, missing, doc = np.zeros(0, np.uint32), [], -1, -1
    while doc + 1 < n or missing > 0:
        if missing <= 0:
            doc += 1
            missing, parts = int(sizes[doc]), []
        if missing and not len(ids):
            n_blocks = int(np.frombuffer(source.read(4), "<u4")[0])
            heads = np.frombuffer(source.read(8 * n_blocks), "<u4").reshape(n_blocks, 2).tolist()
            ids = decode_group([(count, source.read(length)) for count, length in heads])
        part, ids = ids[:missing], ids[missing:]
        parts.append(part)
        missing -= len(part)
        if not missing:
            yield (int(names[doc]) if known[doc] else None), int(sizes[doc]), parts


def write_token_files(docs: DataFrame, folder: str, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Tokenize docs (doc_id, text) and write the ids in ascending order of doc_id; returns the manifest.

    path names a byte-level tokenizer file. Each document's ids end in id 0; null and empty texts have only
    that. Null ids come first; rows of one id follow the hash of their texts. Other columns are ignored. An
    empty table gives an empty manifest. A task that fails leaves a file that no manifest names;
    files of tasks that ended stay, so a lost executor costs its open file only.
    """
    rows = needed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = _place(folder)
        part, ids_of, writer = TaskContext.get().partitionId(), ids_of_file(path), None
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(at, BATCH_ROWS)
                if writer is None:
                    file = f"part-{part:07d}-{uuid.uuid4().hex}.ids"
                    system.create_dir(root, recursive=True)
                    writer = _Writer(system.open_output_stream(f"{root}/{file}"))
                writer.add(some.column("doc_id").to_pylist(), *with_ends(*ids_of.encode(some.column("text").to_pylist())))
        if writer is not None:
            writer.close()
            size = writer.stream.tell()
            writer.stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids, "n_bytes": size}], schema)

    columns = [("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]
    schema = pa.schema(columns)
    written = dealt.mapInArrow(write, "part int, file string, n_docs long, n_ids long, n_bytes long")
    # one row for each file, not for each document
    files = sorted(written.collect(), key=lambda r: r["part"])
    starts = accumulate((r["n_ids"] for r in files), initial=0)
    spark = docs.sparkSession
    manifest = spark.createDataFrame([(r["part"], r["file"], s, r["n_docs"], r["n_ids"], r["n_bytes"]) for r, s in zip(files, starts, strict=False)], MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_manifest(spark, folder)


def open_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of a folder.

    start counts the ids of all documents before, over all files. A file is read by one task, group by
    group. A damaged file raises an error.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    manifest = open_manifest(spark, folder)
    n = max(1, manifest.count())

    def read(batch):
        system, root = _place(folder)
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
            out: dict[str, list] = {name: [] for name in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")}
            waiting = 0
            with system.open_input_file(f"{root}/{file}") as source:
                for doc_id, size, parts in read_file(source):
                    check = 0
                    for part in parts:
                        check = zlib.crc32(np.ascontiguousarray(part, "<u4"), check)
                    ids = np.concatenate(parts) if with_ids else None
                    for name, value in zip(out, (doc_id, start, size, check, ids), strict=True):
                        out[name].append(value)
                    start += size
                    waiting += size if with_ids else 1
                    if waiting >= 1 << 20:
                        yield out
                        out, waiting = {name: [] for name in out}, 0
            yield out

    return map_batches(manifest.select("part", "file", "start").repartitionById(n, F.col("part") % n), read, schema, rows=1)


def token_files(docs: DataFrame, path: str, folder: str | None = None, **options) -> DataFrame:
    """Write the files, in a new folder below the shared one unless one is named, and read them back without the ids."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path, **options)
    return read_token_files(spark, folder, with_ids=False)
