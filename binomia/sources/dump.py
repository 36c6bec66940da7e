"""Taxonomy dump files and lookup tables."""

import logging
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import Lookup
from ..session import shared_folder
from .files import kind_of, row_place

log = logging.getLogger(__name__)

DUMP_FILES = ("nodes.dmp", "names.dmp", "merged.dmp")
#: Bytes of the lines that a task unpacks at a time.
_BATCH_BYTES = 4 << 20

RECORD = (
    "struct<TaxId:string,ScientificName:string,ParentTaxId:string,Rank:string,"
    "OtherNames:struct<Synonym:array<string>,GenbankSynonym:array<string>,"
    "EquivalentName:array<string>,Includes:array<string>,"
    "Name:array<struct<ClassCDE:string,DispName:string>>>,"
    "Lineage:string,LineageEx:array<struct<TaxId:string,ScientificName:string,Rank:string>>,"
    "AkaTaxIds:array<string>,MergedTaxIds:array<string>>"
)
# The same with the parts as text that foreign files write as a scalar or a list.
LOOSE_RECORD = (
    "struct<TaxId:string,ScientificName:string,ParentTaxId:string,Rank:string,"
    "OtherNames:struct<Synonym:string,GenbankSynonym:string,EquivalentName:string,"
    "Includes:string,Name:string>,"
    "Lineage:string,LineageEx:array<struct<TaxId:string,ScientificName:string,Rank:string>>,"
    "AkaTaxIds:array<string>,MergedTaxIds:array<string>>"
)


def dump_fields(lines: DataFrame) -> DataFrame:
    r"""Split ``value`` at ``\t|\t`` after dropping the line end ``\t|``."""
    bare = F.regexp_replace("value", r"\t\|$", "")
    return lines.select("line_no", F.split(bare, r"\t\|\t").alias("fields"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, fields`` of a dump file or a folder of its parts; ``line_no`` grows with the file over all splits."""
    lines, place = row_place(spark.read.text(str(path)))
    return dump_fields(lines.withColumn("line_no", place))


def resolve_dump(spark: SparkSession, path, work_dir: str | None = None) -> str:
    """Folder with the dump files, unpacked by Spark first if ``path`` is a tar archive.

    Both may lie on any file system that Spark reads. Archives are unpacked below ``work_dir``, or below
    the folder that driver and executors share.
    """
    path = str(path)
    kind = kind_of(spark, path)
    if kind == "folder":
        return path
    if kind == "file" and path.endswith((".tar.gz", ".tgz", ".tar")):
        return _unpack(spark, path, f"{work_dir or shared_folder(spark)}/dump-{uuid.uuid4().hex}")
    raise FileNotFoundError(f"no dump folder or archive: {path}")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """``member, copy, line_no, value``: the lines of the dump files of an archive, a batch at a time.

    A compressed stream has one reader, so a task unpacks an archive; it holds the compressed bytes (2 GB
    at most, as Spark's cells) and one batch of lines. ``copy`` tells members of one name apart.
    """
    schema = "member string, copy int, line_no long, value string"

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                with tarfile.open(fileobj=pa.BufferReader(content.as_buffer()), mode="r|*") as tar:
                    for copy, member in enumerate(tar):
                        name = member.name.rsplit("/", 1)[-1]
                        if name not in DUMP_FILES or not member.isfile():
                            continue
                        source, at = tar.extractfile(member), 0
                        while lines := source.readlines(_BATCH_BYTES):
                            n = len(lines)
                            yield pa.RecordBatch.from_arrays(
                                [
                                    pa.array([name] * n), pa.array([copy] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()),
                                    pa.array([x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines]),
                                ],
                                names=["member", "copy", "line_no", "value"],
                            )
                            at += n

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _unpack(spark: SparkSession, path: str, target: str) -> str:
    """Write each dump file of an archive as a folder of ordered parts; of several with one name the last."""
    archive_lines(spark, path).write.parquet(f"{target}/lines")
    lines = spark.read.parquet(f"{target}/lines")
    for row in lines.groupBy("member").agg(F.max("copy").alias("copy")).collect():  # at most one row a dump file
        own = lines.filter((F.col("member") == row["member"]) & (F.col("copy") == row["copy"])).select("line_no", "value")
        parts = own.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value")
        parts.write.text(f"{target}/{row['member']}")
    return target


def save_lookup(lookup: Lookup, path: str) -> None:
    lookup.keys.write.mode("overwrite").parquet(f"{path}/keys")
    lookup.records.write.mode("overwrite").parquet(f"{path}/records")


def load_lookup(spark: SparkSession, path: str) -> Lookup:
    """Stored lookup; an empty one with a warning where nothing is stored."""
    kind = kind_of(spark, path)
    # what lies there decides, not how it is called: tables, else JSON
    if kind == "file" or (kind == "folder" and not kind_of(spark, f"{path}/keys")):
        return import_lookup(spark, path)
    if not kind:
        log.warning("no lookup at %s", path)
        return empty_lookup(spark)
    return Lookup(spark.read.parquet(f"{path}/keys"), spark.read.parquet(f"{path}/records"))


def empty_lookup(spark: SparkSession) -> Lookup:
    keys = spark.createDataFrame(
        [], "key string, ord int, rec_id string, scientific_name string"
    )
    return Lookup(keys, spark.createDataFrame([], f"rec_id string, record {RECORD}"))


def import_lookup(spark: SparkSession, path: str) -> Lookup:
    """Lookup from a JSON object ``{key: [record, ...]}``.

    A folder is what :func:`export_lookup` writes, one key per line in any number of parts, and is
    read in parallel. A single file cannot be split, so one task parses it; store the result with
    :func:`save_lookup`. A missing or broken file gives an empty lookup; other failures are raised.
    """
    kind = kind_of(spark, path)
    if not kind:
        log.warning("no lookup at %s", path)
        return empty_lookup(spark)
    if kind == "folder":
        lines = spark.read.text(path).filter(~F.trim("value").isin("{", "}", ""))
        text = lines.select(F.concat(F.lit("{"), F.regexp_replace("value", "^,", ""), F.lit("}")).alias("value"))
    else:
        text = spark.read.text(path, wholetext=True)
    parsed = text.select(
        F.explode(F.from_json("value", F.lit(f"map<string,array<{LOOSE_RECORD}>>"))).alias("key", "recs")
    )
    if parsed.isEmpty():
        log.error("lookup %s is empty or no JSON object", path)
        return empty_lookup(spark)
    rows = parsed.select("key", F.posexplode("recs").alias("ord", "raw")).select(
        "key", "ord", _strict_record("raw").alias("record")
    )
    rows = rows.withColumn("rec_id", F.sha2(F.to_json("record"), 256))
    return Lookup(
        rows.select("key", "ord", "rec_id", F.col("record.ScientificName").alias("scientific_name")),
        rows.groupBy("rec_id").agg(F.first("record").alias("record")),
    )


def _strict_record(name):
    r = F.col(name)
    other = r["OtherNames"]

    def listed(text):
        as_list = F.from_json(text, F.lit("array<string>"))
        return F.when(F.startswith(text, F.lit("[")), as_list).otherwise(
            F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))
        )

    shown = F.transform(
        listed(other["Name"]),
        lambda n: F.struct(
            F.get_json_object(n, "$.ClassCDE").alias("ClassCDE"),
            F.when(F.startswith(n, F.lit("{")), F.get_json_object(n, "$.DispName")).otherwise(n).alias("DispName"),
        ),
    )
    names = F.struct(
        *[listed(other[c]).alias(c) for c in ("Synonym", "GenbankSynonym", "EquivalentName", "Includes")],
        F.filter(shown, lambda n: n["DispName"].isNotNull()).alias("Name"),
    )
    return r.withField("OtherNames", names)
