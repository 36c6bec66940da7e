"""Writers of run files."""

import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import Lookup
from .files import make_folder


def run_folders(spark: SparkSession, base: str, name: str = "", now: datetime | None = None):
    """Job id and folder of a run, with ``debug`` and ``results`` in it, on any file system that Spark writes."""
    stamp = (now or datetime.now()).strftime("%Y%m%d_%H%M%S")
    job_id = f"{name}_{stamp}" if name else stamp
    folder = f"{str(base).rstrip('/')}/" + (f"run_{stamp}_{name}" if name else f"run_{stamp}")
    for part in ("debug", "results"):
        make_folder(spark, f"{folder}/{part}")
    return job_id, folder


def csv_ready(df: DataFrame) -> DataFrame:
    """Flags as ``True``/``False`` and arrays as text."""
    changes = {}
    for name, kind in df.dtypes:
        if kind == "boolean":
            changes[name] = F.initcap(F.col(name).cast("string"))
        elif kind == "array<struct<g:string,s:string>>":
            pairs = F.transform(name, lambda a: F.concat_ws(" ", a["g"], a["s"]))
            changes[name] = F.array_join(pairs, "|")
        elif kind == "array<string>":
            changes[name] = F.array_join(name, ";")
    return df.withColumns(changes) if changes else df


def write_csv(df: DataFrame, path, order=(), columns=None) -> None:
    """CSV in the given order, as a folder of ordered parts."""
    rows = df.orderBy(*order) if order else df
    rows = rows.select(*columns) if columns else rows.drop("pos", "group_pos", "tie_id")
    # blanks at the ends of a cell are part of it
    csv_ready(rows).write.mode("overwrite").csv(
        str(path), header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def write_json_document(head: str, rows: DataFrame, order, tail: str, path) -> None:
    """One JSON document as a folder of ordered text parts, one item per line.

    ``rows`` has a ``text`` column. The document never passes through one task: parts
    are ranges of the order, and joining them in name order gives the document.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select(*[c.alias(k) for k, c in zip(keys, order)], "text")
    first = keyed.agg(F.min(F.struct(*keys)).alias("k"))
    start = F.struct(*keys).eqNullSafe(first.select("k").scalar())
    body = keyed.select(
        F.lit(1).alias("_part"), *keys, F.concat(F.when(start, "").otherwise(","), "text").alias("text")
    )
    spark = rows.sparkSession
    frame = spark.range(1).select(
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("_part"), F.lit(head).alias("text")),
                F.struct(F.lit(2).alias("_part"), F.lit(tail).alias("text")),
            )
        )
    )
    whole = body.unionByName(frame, allowMissingColumns=True)
    whole.orderBy("_part", *keys).select("text").write.mode("overwrite").text(str(path))


def write_report(items: DataFrame, job_id: str, order, path, timestamp: str) -> None:
    """Report document; nulls are kept."""
    fields = ["query_name", "abundance", "mapped_id", "status", "confidence_score", "candidates"]
    total = items.count()
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    head = (
        f'{{"jobId": {json.dumps(job_id)}, "timestamp": {json.dumps(timestamp)}, '
        f'"total_bacteria": {total}, "results": ['
    )
    write_json_document(head, items.withColumn("text", text), order, "]}", path)


def export_lookup(lookup: Lookup, path) -> None:
    """Lookup as one JSON object ``{key: [record]}``."""
    entry = F.to_json("record", {"ignoreNullFields": "false"})
    listed = (
        lookup.keys.join(lookup.records, "rec_id")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))).alias("es"))
    )
    items = F.array_join(F.transform("es", lambda x: x["e"]), ",")
    name = F.to_json(F.array("key"))
    quoted = F.substring(name, F.lit(2), F.length(name) - 2)
    rows = listed.withColumn("text", F.concat(quoted, F.lit(": ["), items, F.lit("]")))
    write_json_document("{", rows, [F.col("key")], "}", path)


def read_document(path) -> str:
    """Text of a document written in parts; for small files and tests."""
    parts = sorted(Path(path).glob("part-*"))
    return "".join(p.read_text(encoding="utf-8") for p in parts)
