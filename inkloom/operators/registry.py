"""The converter registry as a small table, and what is decided by joining hints with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import hints as H
from inkloom.model import GENERIC
from inkloom.sources.engine import FORMATS, PLAIN_TEXT, Converter

SCHEMA = "name string, priority int, seq int, extensions array<string>, mime_prefixes array<string>, input_limit long, is_fallback boolean"


def registry(spark: SparkSession, extra: list[tuple[Converter, int]] | None = None, with_builtins: bool = True) -> DataFrame:
    """One row for each registration in the order made; a handful of rows."""
    made = ([(PLAIN_TEXT, GENERIC), *FORMATS] if with_builtins else []) + list(extra or [])
    rows = [(c.name, p, i, list(c.extensions), list(c.mime_prefixes), c.input_limit, c.is_fallback) for i, (c, p) in enumerate(made)]
    return spark.createDataFrame(rows, SCHEMA)


def ranked(reg: DataFrame) -> DataFrame:
    """Registrations with their rank: lower priority first, later registration first among equals."""
    return reg.withColumn("rank", F.row_number().over(Window.orderBy(F.col("priority").asc(), F.col("seq").desc())))


def completed(df: DataFrame) -> DataFrame:
    """df with extension and media type filled from each other and from the filename."""
    ext = H.filled(F.lower("extension"), H.extension_of("filename"))
    mime = H.filled("mime_type", H.mime_of_extension(ext))
    return df.withColumns({"__ext": H.filled(ext, H.extension_of_mime(mime)), "__mime": mime})


def _takes() -> Column:
    by_name = H.accepts("__mime", "__ext", F.col("r.extensions"), F.col("r.mime_prefixes"))
    return by_name | (F.col("r.is_fallback") & (F.coalesce(F.col("charset"), F.lit("")) != ""))


def candidates(df: DataFrame, reg: DataFrame, id_col: str) -> DataFrame:
    """(id, converter, priority, rank): the accepting converters of each stream in the order in which they are tried.

    The registry is broadcast: it has one row a registration.
    """
    return completed(df).alias("s").join(F.broadcast(ranked(reg)).alias("r"), _takes(), "inner").select(F.col(f"s.{id_col}"), F.col("r.name").alias("converter"), F.col("r.priority"), F.col("r.rank"))


def can_convert(df: DataFrame, reg: DataFrame) -> DataFrame:
    """The rows that a converter other than the fallback accepts by hints alone: a left semi join."""
    own = reg.where("not is_fallback").alias("r")
    return completed(df).alias("s").join(F.broadcast(own), H.accepts("__mime", "__ext", F.col("r.extensions"), F.col("r.mime_prefixes")), "left_semi").drop("__ext", "__mime")


def unsupported(df: DataFrame, reg: DataFrame) -> DataFrame:
    """The rows that no converter at all accepts: a left anti join."""
    return completed(df).alias("s").join(F.broadcast(reg.alias("r")), _takes(), "left_anti").drop("__ext", "__mime")


def smallest_limits(df: DataFrame, reg: DataFrame, id_col: str) -> DataFrame:
    """(id, input_limit): the smallest size limit over the accepting converters; null without any."""
    limit = candidates(df, reg, id_col).join(F.broadcast(reg.select(F.col("name").alias("converter"), "input_limit")), "converter").groupBy(id_col).agg(F.min("input_limit").alias("input_limit"))
    return df.select(id_col).distinct().join(limit, id_col, "left")


def guess_count(df: DataFrame, found: Column | str) -> Column:
    """1 when the hint agrees with the sniffed media type, else 2 interpretations are tried."""
    f = F.col(found) if isinstance(found, str) else found
    mime = F.col("__mime")
    agree = (mime == "") | (F.lower(mime) == F.lower(f)) | (H.ooxml(mime) & (f == "application/zip")) | (H.text_like(mime) & f.startswith("text/"))
    return F.when(H.zip_type(mime) & H.ooxml(f), 2).when(agree, 1).otherwise(2)


def merged_hints(a: str, b: str, fields: list[str]) -> Column:
    """A hints struct with its empty fields filled from another."""
    return F.struct(*[H.filled(F.col(f"{a}.{n}"), F.col(f"{b}.{n}")).alias(n) for n in fields])
