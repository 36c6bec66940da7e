"""Query tables and catalogues."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as V
from .files import row_place

# Texts that count as missing in a CSV file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


#: Column with the place of a row in its file.
_PLACE = "_place"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header, all columns as text, and the place of each row in the file.

    With ``multi_line`` quoted cells may hold line breaks; then one task reads a file.
    """
    raw, place = row_place(spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multi_line))
    columns = [c for c in raw.columns if c not in ("_start", "_file", "_no", "_in_task", "_path")]
    return raw.select(*[F.col(f"`{c}`") for c in columns], place.alias(_PLACE))


def _row_place(raw: DataFrame) -> Column:
    return F.col(_PLACE) if _PLACE in raw.columns else F.monotonically_increasing_id()


def pick_column(columns, wanted, default=None):
    return next((c for c in wanted if c in columns), default)


def name_text(column) -> Column:
    """Missing names read as the text ``nan``."""
    return F.when(column.isNull() | column.isin(MISSING), "nan").otherwise(column)


def abundance_value(column) -> Column:
    number = F.trim(column.cast("string")).try_cast("double")
    return F.when(number.isNull() | F.isnan(number), 0.0).otherwise(number)


def as_queries(raw: DataFrame) -> DataFrame:
    """``pos, taxa_name, abundance`` of a raw table.

    ``pos`` grows with the row order of the file. Abundance is null without such a
    column.
    """
    columns = [c for c in raw.columns if c != _PLACE]
    name = pick_column(columns, V.NAME_COLUMNS, columns[0])
    abundance = pick_column(columns, V.ABUNDANCE_COLUMNS)
    value = abundance_value(F.col(abundance)) if abundance else F.lit(None).cast("double")
    return raw.select(
        _row_place(raw).alias("pos"),
        name_text(F.col(name).cast("string")).alias("taxa_name"),
        value.alias("abundance"),
    )


def read_queries(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return as_queries(read_csv(spark, path, multi_line))


def as_catalogue(raw: DataFrame) -> DataFrame:
    """``model_pos, model`` of a table with a ``Filename`` column."""
    model = F.regexp_replace(name_text(F.col("Filename")), r"\.mat$", "")
    return raw.select(_row_place(raw).alias("model_pos"), model.alias("model"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    return as_catalogue(read_csv(spark, path))
