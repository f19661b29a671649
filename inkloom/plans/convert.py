"""Conversion of a DataFrame of streams: the public entry of the engine.

The attempt chain is sequential for one document, so it runs inside one Python function over Arrow
batches; nothing is shuffled and the bytes never leave the task that read them. Where the rows have a length column,
the smallest limit of the converters that take a stream by its hints is tested on it, and the content of
what is too large is not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from inkloom.functions import hints as H
from inkloom.model import ERROR, HINTS, INPUT_TOO_LARGE, INTERNAL, WARNING, ConversionFailed, Hints, Options
from inkloom.sources.engine import FORMATS, Converter, default_engine, error_code

RESULT_FIELDS = [T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType()), T.StructField("warnings", T.ArrayType(WARNING)), T.StructField("error", ERROR), T.StructField("converter", T.StringType())]


def hints_column(df: DataFrame) -> Column:
    """A hints struct from whatever hint columns there are; null and missing are ''."""
    return F.struct(*[(F.coalesce(df[n], F.lit("")) if n in df.columns else F.lit("")).alias(n) for n in HINTS.names])


def convert_one(content: bytes | None, hints: dict | None, options: Options, engine) -> dict:
    """The result struct of one document; warnings are never null, null content is unsupported."""
    try:
        res = engine.convert(content or b"", Hints.of(hints), options)
    except Exception as e:  # every failure becomes a typed error of its row
        code = error_code(e)
        attempts = [{"converter": c, "message": m} for c, m in e.attempts] if isinstance(e, ConversionFailed) else []
        return {"markdown": None, "title": "", "warnings": [], "error": {"code": code, "message": f"{type(e).__name__}: {e}" if code == INTERNAL else str(e), "attempts": attempts}, "converter": None}
    return {"markdown": res.markdown, "title": res.title, "warnings": [vars(w) for w in res.warnings], "error": None, "converter": res.converter}


def limit_by_hints(hints: Column, extra: Iterable[tuple[Converter, int]] = ()) -> Column:
    """(limit, converter): the smallest input limit of the converters that take a stream by its hints alone; null without any.

    Converters with a test of their own (accepts) are left to the attempt chain.
    """
    ext = H.filled(F.lower(hints["extension"]), H.extension_of(hints["filename"]))
    mime = H.filled(hints["mime_type"], H.mime_of_extension(ext))
    ext = H.filled(ext, H.extension_of_mime(mime))
    limited = [c for c, _ in [*FORMATS, *extra] if c.input_limit and not c.accepts]
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    found = [F.when(H.accepts(mime, ext, texts(c.extensions), texts(c.mime_prefixes)), F.struct(F.lit(c.input_limit).cast("long").alias("limit"), F.lit(c.name).alias("converter"))) for c in limited]
    return F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))


def convert(df: DataFrame, options: Options | None = None, extra: Iterable[tuple[Converter, int]] = (), content: str = "content", batch_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """df with markdown, title, warnings, error and converter in place of the content and the hint columns.

    ``extra`` are converters of the caller with their priorities; a later one of equal priority shadows the
    built-in. Columns of df that have the name of a result column are replaced by it. An empty df
    gives an empty result; repeated rows are converted each for itself. Rows whose ``length`` is above the limit
    of a converter that takes them by hints become INPUT_TOO_LARGE without their content.
    """
    options = options or Options()
    extra = list(extra)
    taken = {f.name for f in RESULT_FIELDS}
    keep = [c for c in df.columns if c != content and c not in HINTS.names and c not in taken]
    fields = [df.schema[c] for c in keep] + RESULT_FIELDS
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)
    hints = hints_column(df)
    refused = None
    if "length" in df.columns:
        limit = limit_by_hints(hints, extra)
        large = F.coalesce(df["length"] > limit["limit"], F.lit(False))
        message = F.concat(limit["converter"], F.lit(": input is "), df["length"].cast("string"), F.lit(" bytes; limit is "), limit["limit"].cast("string"))
        error = F.struct(F.lit(INPUT_TOO_LARGE).alias("code"), message.alias("message"), F.array().cast(ERROR["attempts"].dataType).alias("attempts"))
        columns = {"markdown": F.lit(None).cast("string"), "title": F.lit(""), "warnings": F.array().cast(T.ArrayType(WARNING)), "error": error, "converter": F.lit(None).cast("string")}
        refused = df.where(large).select(*[df[c] for c in keep], *[columns[f.name].cast(f.dataType).alias(f.name) for f in RESULT_FIELDS])
        df = df.where(~large)
    data = df.select(*[df[c] for c in keep], hints.alias("__hints"), df[content].alias("__content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = default_engine()
        if extra:
            from inkloom.sources.engine import Engine

            engine = Engine()
            for c, p in [*FORMATS, *extra]:
                engine.register(c, p)
        for batch in batches:
            start = size = 0
            contents = batch.column(batch.num_columns - 1)
            for i in range(batch.num_rows):
                size += contents[i].as_buffer().size if contents[i].is_valid else 0
                # Small output batches: one document may be 64 MiB.
                if size > batch_bytes or i + 1 - start >= 512 or i + 1 == batch.num_rows:
                    part = batch.slice(start, i + 1 - start)
                    rows = [convert_one(c, h, options, engine) for h, c in zip(part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True)]
                    columns = [part.column(k) for k in range(len(keep))]
                    columns += [pa.array([r[f.name] for r in rows], arrow.field(f.name).type) for f in RESULT_FIELDS]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                    start, size = i + 1, 0

    done = data.mapInArrow(run, schema)
    return done if refused is None else done.unionByName(refused)


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """Files as streams with hints from their names; a size limit is pushed down to the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if max_bytes is not None:
        files = files.where(F.col("length") <= max_bytes)
    return with_file_hints(files)


def with_file_hints(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    return files.select("path", "modificationTime", "length", "content", ext.alias("extension"), name.alias("filename"), F.regexp_replace("path", "^file:/*", "/").alias("local_path"))


def to_json_lines(results: DataFrame) -> DataFrame:
    """One JSON object a row: markdown, title and warnings, or error; for a text sink."""
    ok = F.to_json(F.struct("markdown", "title", F.coalesce("warnings", F.array().cast(T.ArrayType(WARNING))).alias("warnings")))
    return results.select(F.when(F.col("error").isNull(), ok).otherwise(F.to_json(F.struct("error"))).alias("value"))
