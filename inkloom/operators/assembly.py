"""Table-level steps of the converters: grids, sections, budgets, warnings, pages, charts, order, lookups.

Groups are the parts of one document (its rows, members, pages, warnings), which the formats bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.model import INCOMPLETE, MAX_WARNINGS, SUPPRESSED


def fitted_cells(rows: DataFrame, keys: list[str], cells: str = "cells", row_no: str = "row_no") -> DataFrame:
    """Every row as wide as its document's first: shorter ones padded with '', longer ones cut."""
    width = rows.groupBy(*keys).agg(F.min_by(F.size(cells), row_no).alias("__width"))
    padded = F.slice(F.concat(F.col(cells), F.array_repeat(F.lit(""), F.greatest(F.col("__width") - F.size(cells), F.lit(0)))), 1, F.greatest(F.col("__width"), F.lit(1)))
    return rows.join(width, keys).withColumn(cells, F.when(F.col("__width") > 0, padded).otherwise(F.array().cast("array<string>"))).drop("__width")


def normalized_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, row, col, text) as full rows up to the last row and column that is not blank.

    A document of blank cells only has no rows; of repeated cells the greatest text counts.
    """
    filled = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != ""
    shape = cells.where(filled).groupBy(*keys).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    frame = shape.select(*keys, "cols", F.explode(F.sequence(F.lit(0), F.col("rows"))).alias("row"))
    have = cells.groupBy(*keys, "row", "col").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    line = F.transform(F.sequence(F.lit(0), F.col("cols")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit("")))
    return frame.join(have, [*keys, "row"], "left").select(*keys, "row", F.when(F.col("m").isNull(), F.array_repeat(F.lit(""), F.col("cols") + 1)).otherwise(line).alias("cells"))


def joined_parts(parts: DataFrame, keys: list[str], text: Column | str, order: str, glue: str, name: str = "markdown") -> DataFrame:
    """Ordered concatenation of a document's parts; null and empty parts are left out."""
    t = F.col(text) if isinstance(text, str) else text
    kept = parts.select(*keys, F.col(order).alias("__o"), t.alias("__t")).where("__t is not null and __t <> ''")
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__o", "__t"))), lambda e: e["__t"]), glue).alias(name))


def file_section(name: Column | str, markdown: Column | str) -> Column:
    n, m = (F.col(x) if isinstance(x, str) else x for x in (name, markdown))
    return F.concat(F.lit("\n## File: "), n, F.lit("\n\n"), m, F.lit("\n"))


def sheet_section(name: Column | str, table: Column | str) -> Column:
    n, t = (F.col(x) if isinstance(x, str) else x for x in (name, table))
    return F.concat(F.lit("## "), n, F.lit("\n\n"), F.coalesce(t, F.lit("")))


def running_bytes(df: DataFrame, keys: list[str], order: list[str], text: str, name: str = "bytes_so_far") -> DataFrame:
    """Bytes of UTF-8 up to and with each part, in order."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(F.octet_length(text), F.lit(0))).over(w))


def within_budget(df: DataFrame, keys: list[str], order: list[str], text: str, limit: int) -> DataFrame:
    """The leading parts whose bytes together stay within the limit: as soon as one does not fit, none after it is kept."""
    return running_bytes(df, keys, order, text, "__sum").where(F.col("__sum") <= limit).drop("__sum")


def first_members(df: DataFrame, keys: list[str], order: list[str], counts: Column, most: int) -> DataFrame:
    """Members until so many that count have been met; those that do not count pass before the stop."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__n", F.coalesce(F.sum(counts.cast("int")).over(w), F.lit(0))).where(F.col("__n") < most).drop("__n")


def bounded_warnings(warnings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, warnings): at most 256; what would be the last becomes the note that more were suppressed.

    The note has the 256th warning's converter, the code incomplete and no location. Warnings beyond are
    dropped before anything is gathered, so a group holds at most 256.
    """
    w = Window.partitionBy(*keys).orderBy(order, "code", "location", "message")
    numbered = warnings.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MAX_WARNINGS)
    last = F.col("__n") == MAX_WARNINGS
    fields = [F.col("converter"), F.when(last, INCOMPLETE).otherwise(F.col("code")).alias("code"), F.when(last, "").otherwise(F.coalesce("location", F.lit(""))).alias("location"), F.when(last, SUPPRESSED).otherwise(F.col("message")).alias("message")]
    rows = numbered.select(*keys, F.struct("__n", *fields).alias("w"))
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("w")), lambda x: F.struct(x["converter"].alias("converter"), x["code"].alias("code"), x["location"].alias("location"), x["message"].alias("message"))).alias("warnings"))


def warning_text(converter: Column | str = "converter", location: Column | str = "location", message: Column | str = "message") -> Column:
    """converter: location: message, with empty parts left out; without a converter the message alone."""
    c, loc, m = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (converter, location, message))
    return F.when(c == "", m).otherwise(F.concat_ws(": ", c, F.nullif(loc, F.lit("")), m))


def relocated(location: Column | str, member: Column | str) -> Column:
    """A member's own location seen from the archive."""
    loc, n = (F.col(x) if isinstance(x, str) else x for x in (location, member))
    return F.when(F.coalesce(loc, F.lit("")) == "", n).otherwise(F.concat(n, F.lit(": "), loc))


def failure_text(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message): the attempts of each document in order, below a line that counts them."""
    line = F.concat(F.lit("\n  "), "converter", F.lit(": "), F.coalesce("message", F.lit("")))
    rows = attempts.select(*keys, F.struct("attempt_no", line.alias("line")).alias("e"))
    lines = F.transform(F.sort_array(F.collect_list("e")), lambda e: e["line"])
    return rows.groupBy(*keys).agg(F.concat(F.lit("conversion failed after "), F.count("*").cast("string"), F.lit(" attempt(s):"), F.array_join(lines, "")).alias("message"))


def page_documents(pages: DataFrame, keys: list[str], marker: str = "inkloom") -> DataFrame:
    """(keys, markdown): pages with text joined by a blank line in order, OCR pages behind a marker comment.

    Repeated rows of a page count once (the greatest text).
    """
    one = pages.groupBy(*keys, "page_no").agg(F.max_by(F.struct("text", "ocr_glyphs"), F.struct(F.coalesce("text", F.lit("")), F.coalesce("ocr_glyphs", F.lit(0)))).alias("p")).select(*keys, "page_no", "p.text", "p.ocr_glyphs")
    mark = F.concat(F.lit(f"<!-- {marker}: page "), F.col("page_no").cast("string"), F.lit(" includes OCR text -->\n\n"))
    text = F.when(F.coalesce("text", F.lit("")) == "", None).otherwise(F.concat(F.when(F.col("ocr_glyphs") > 0, mark).otherwise(""), "text"))
    return joined_parts(one, keys, text, "page_no", "\n\n")


def page_warning(has_ocr: bool, ocr_failed: Column | None = None) -> Column:
    """Why a page without text has none; null for pages with text or without anything to say."""
    from inkloom.sources.pdf import NO_IMAGES, SCANNED

    failed = ocr_failed if ocr_failed is not None else F.lit(False)
    return F.when(F.coalesce("text", F.lit("")) != "", None).when(failed, None).when(F.coalesce("image_count", F.lit(0)) > 0, SCANNED).when(F.lit(has_ocr), NO_IMAGES)


def thin_page(floor: int) -> Column:
    """Pages for OCR: without text, or with fewer glyphs than the floor and an image."""
    return (F.coalesce("text", F.lit("")) == "") | ((F.coalesce("n_glyphs", F.lit(0)) < floor) & (F.coalesce("image_count", F.lit(0)) > 0))


def ocr_budget(pages: DataFrame, keys: list[str], chosen: Column, most: int) -> DataFrame:
    """The chosen pages with their number in the budget; refused is true beyond it, first_refusal for one page a document."""
    w = Window.partitionBy(*keys).orderBy("page_no")
    return pages.where(chosen).withColumn("ocr_no", F.row_number().over(w)).withColumns({"refused": F.col("ocr_no") > most, "first_refusal": F.col("ocr_no") == most + 1})


def reading_order(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items by y, then x, then their base order; without a position they come first."""
    w = Window.partitionBy(*keys).orderBy(F.col("y").asc_nulls_first(), F.col("x").asc_nulls_first(), F.col("seq"))
    return items.withColumn("position", F.row_number().over(w))


def chart_table(cats: DataFrame, values: DataFrame, series: list[str]) -> DataFrame:
    """Rows of a chart: a full outer join of categories (idx, category) and values (idx, series_name, value).

    The series' names are given, as columns need them; gaps are ''.
    """
    wide = values.groupBy("idx").pivot("series_name", series).agg(F.max("value"))
    joined = cats.join(wide, "idx", "full")
    return joined.select("idx", F.coalesce("category", F.lit("")).alias("category"), *[F.coalesce(F.col(f"`{s}`"), F.lit("")).alias(s) for s in series])


def heading_levels(styles: DataFrame, hops: int = 9, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, style_id, level): heading level of each style by id or name, outline level, or the style it is based on, at most hops away.

    keys name the document, where styles holds those of many. A style that is based on one that is not there
    takes the level of that one's id.

    An iterative self-join over the few styles that have no level yet; cycles end with the hops. Level 0: no heading.
    """
    def named(c: str) -> Column:
        n = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", ""))
        m = F.regexp_extract(n, r"^heading\s*([1-9])$", 1)
        return F.when(n == "title", 1).when(m != "", m.try_cast("int"))

    own = F.coalesce(named("style_id"), named("name"), F.when(F.col("outline_lvl").between(0, 8), F.col("outline_lvl") + 1))
    base = styles.select(*keys, "style_id", own.alias("own"), F.nullif("based_on", F.lit("")).alias("based_on"))
    at = base.select(*keys, "style_id", F.col("own").alias("level"), F.when(F.col("own").isNull(), F.col("based_on")).alias("next"))
    up = base.select(*keys, F.col("style_id").alias("next"), F.col("own").alias("up_level"), F.col("based_on").alias("up_next"))
    for _ in range(hops):
        level = F.coalesce("level", "up_level", named("next"))
        at = at.join(up, [*keys, "next"], "left").select(*keys, "style_id", level.alias("level"), F.when(level.isNull(), F.col("up_next")).alias("next"))
    return at.select(*keys, "style_id", F.coalesce("level", F.lit(0)).alias("level"))


def list_kinds(paragraphs: DataFrame, numbers: DataFrame, levels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """paragraphs (keys, num_id, ilvl) with kind 'ordered', 'bullet' or null for no list: two lookups in a row.

    A number that is there but has no definition, or none of the level, makes bullets.
    """
    known = numbers.select(*keys, "num_id", "abstract_id").dropDuplicates([*keys, "num_id"]).withColumn("__known", F.lit(True))
    fmt = levels.select(*keys, "abstract_id", "ilvl", "num_fmt").dropDuplicates([*keys, "abstract_id", "ilvl"])
    kind = F.when(F.coalesce("num_id", F.lit("")).isin("", "0") | F.col("__known").isNull(), None).when(F.coalesce(F.nullif("num_fmt", F.lit("")), F.lit("bullet")) == "bullet", "bullet").otherwise("ordered")
    return paragraphs.join(known, [*keys, "num_id"], "left").join(fmt, [*keys, "abstract_id", "ilvl"], "left").withColumn("kind", kind).drop("abstract_id", "__known", "num_fmt")


def external_links(links: DataFrame, rels: DataFrame) -> DataFrame:
    """links (rel_id) with href: the target of an external relationship, else null (anchors degrade to their text)."""
    outside = rels.where("external").select(F.col("id").alias("rel_id"), F.col("target").alias("href")).dropDuplicates(["rel_id"])
    return links.join(outside, "rel_id", "left")


def result_status(markdown: Column | str, limit: int) -> Column:
    """The error code of a result by its size in bytes; null when it fits."""
    return F.when(F.octet_length(markdown) > limit, "RESULT_TOO_LARGE")


def truncated_data_uri(src: Column | str) -> Column:
    """data: sources cut behind their head."""
    return F.regexp_replace(F.col(src) if isinstance(src, str) else src, r"^(data:[^,]*,)[\s\S]*$", "$1...")
