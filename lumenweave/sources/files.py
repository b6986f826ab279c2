"""Whole files, listings and delimited text with the columns that must be there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of images that a corpus may hold.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of whole files. The content is read only where it is selected; the scan leaves empty files out, see ``checked``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "content")


def checked(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` names (column ``name``) with what was ``found`` of them; a file that is empty or isn't there is an error."""
    named = found.withColumn("name", F.substring_index("path", "/", -1))
    return wanted.select("name").join(named, "name", "left").withColumn("error", F.when(F.col("path").isNull(), "empty or missing"))


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path and length of the files with one of the suffixes, whatever their case; contents stay unread."""
    return binary_files(spark, path).where(has_suffix(F.col("path"), suffixes)).select("path", "length")


def has_suffix(path: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*suffixes) & path.contains(".")


def table_of(spark: SparkSession, path: str, required: dict[str, str], separator: str = "\t") -> DataFrame:
    """A delimited file with a header, as the required columns of their types. Missing columns are an error, others are dropped; values
    that don't parse are null, but ``inf`` is a number."""
    rows = spark.read.option("header", "true").option("sep", separator).csv(path)
    if missing := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    trimmed = {name: F.trim(F.col(f"`{name}`")) for name in required}
    number = lambda v, kind: F.when(F.lower(v) == "inf", F.lit(float("inf"))).otherwise(v.try_cast(kind)) if kind == "double" else v.try_cast(kind)
    return rows.select(*(number(trimmed[name], kind).alias(name) for name, kind in required.items()))


def write_table(rows: DataFrame, path: str, separator: str = ",") -> None:
    """Delimited text with a header; every value is quoted, and quotes in values are doubled."""
    rows.write.option("header", "true").option("sep", separator).option("quoteAll", "true").option("escape", '"').csv(path)


def parsed(line: Column, schema: str, separator: str = ",") -> Column:
    """A line of delimited text as a struct of ``schema``, and ``bad``: the line itself where a value isn't of its type or there are too few or too many, so that bad lines are rows that can
    be looked at and not nulls. Values may be quoted, with quotes in them doubled."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "sep": separator, "quote": '"', "escape": '"'}
    return F.from_csv(line, f"{schema}, bad STRING", options)


def quoted(*values: Column, separator: str = ",") -> Column:
    """A line of delimited text, as ``write_table`` writes it."""
    return F.concat_ws(separator, *(F.concat(F.lit('"'), F.replace(v.cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for v in values))
