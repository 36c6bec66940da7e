"""Paths of any file system that Spark reads, and the order of rows in files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file that places leave room for: 16 TB.
_FILE_BITS = 44


def _open(spark: SparkSession, path: str):
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(str(path))
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def kind_of(spark: SparkSession, path: str) -> str:
    """What lies at a path: "file", "folder", or "" where nothing does."""
    place, system = _open(spark, path)
    if not system.exists(place):
        return ""
    return "folder" if system.getFileStatus(place).isDirectory() else "file"


def make_folder(spark: SparkSession, path: str) -> None:
    place, system = _open(spark, path)
    system.mkdirs(place)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file."""
    place, system = _open(spark, path)
    stream = system.create(place, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder."""
    place, system = _open(spark, path)
    return system.getContentSummary(place).getLength()


def names_below(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    place, system = _open(spark, path)
    return [status.getPath().getName() for status in system.listStatus(place)]


def row_place(df: DataFrame) -> tuple[DataFrame, Column]:
    """Rows of a file source with a number that grows with the files' names and their lines.

    It is the number of the file, then the byte at which the row's split starts plus the row's place
    in its task. A split has no more rows than bytes, and a task reads at most one split of a file,
    the others of which start where it ends; so numbers never overlap, however many splits
    and tasks a file has.
    """
    in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    place = F.col("_start") + in_task
    df = df.withColumn("_start", F.col("_metadata.file_block_start"))
    files = sorted(df.inputFiles())
    if len(files) <= 1:
        return df, place
    # one row for each file; listings differ in the slashes behind the scheme
    plain = lambda path: F.regexp_replace(path, r"^([A-Za-z0-9+.-]+):/+", "$1:/")
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "_no long, _path string")
    numbered = df.withColumns({"_file": plain(F.col("_metadata.file_path")), "_in_task": in_task}).join(
        F.broadcast(numbers.select("_no", plain(F.col("_path")).alias("_path"))), F.col("_file") == F.col("_path"), "left"
    )
    unknown = F.raise_error(F.concat(F.lit("a file that was not listed: "), "_file")).cast("long")
    number = F.when(F.col("_no").isNull(), unknown).otherwise(F.col("_no"))
    return numbered, F.shiftleft(number, _FILE_BITS) + F.col("_start") + F.col("_in_task")
