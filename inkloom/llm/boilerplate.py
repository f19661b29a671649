"""Problem 3: the main body of web pages, without navigation, notices, sidebars and footers.

Method: consensus host paths. Each page is cut into containers (Markdown has no tags, so a container is a block:
heading, list, table, link bar, text), scored by link share, sentence form and place about the headline. A
container's path is its zone about the headline and its shape: kind, level, share and targets of links, bars, size.
Pages vote in Spark with the scores of their containers: for each host and path the share of furniture among
them; a path of which a host has few containers, and hosts that occur once, take the vote of all hosts. Then
pages are extracted again: a container goes by the vote on its path where that is clear, else by its own score.
Containers that are like body by their shape are voted on by their words: a lead line's first sentence without
marks, targets and years that returns on a good part of its host's pages, or of all pages, is furniture.

Defined results: null or empty Markdown has no lines and no case; a missing url means a host of its own
without name; ties do not arise, as votes are thresholds; repeated records count each for themselves.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.llm import pageparts as P
from inkloom.llm.common import map_rows, scratch_path

#: A path on this share of its host's pages, and on at least so many of them, is furniture.
HOST_SHARE, HOST_PAGES = 0.15, 3
#: A path on this share of all pages, and on at least so many hosts and pages, is furniture.
ALL_SHARE, ALL_HOSTS, ALL_PAGES = 0.007, 4, 4
#: A vote on a path is clear when so many of its containers agree.
CLEAR = 0.8
SALTS = 16

LINES = T.StructType([T.StructField(n, t) for n, t in (("result_id", T.LongType()), ("host", T.StringType()), ("line_no", T.IntegerType()), ("verdict", T.IntegerType()), ("sig", T.LongType()), ("lead", T.LongType()), ("path", T.LongType()), ("first", T.BooleanType()))])


def _hash(text: str) -> int:
    raw = text.encode()
    return zlib.crc32(raw) << 31 | zlib.crc32(raw[::-1] + b"\0") >> 1


def with_host(results: DataFrame, streams: DataFrame) -> DataFrame:
    """HTML results with their stream's host; of several rows of a stream one url is taken (the greatest)."""
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    hosts = streams.where("url is not null and url <> ''").groupBy("stream_id").agg(F.max("url").alias("url")).select("stream_id", host.alias("host"))
    pages = results.where("converter = 'html' and markdown is not null and markdown <> ''").select("result_id", "stream_id", "markdown", "title")
    return pages.join(hosts, "stream_id", "left").select("result_id", F.coalesce("host", F.lit("")).alias("host"), "markdown", "title")


def _line_rows():
    def row(key, host, markdown, title):
        site = P.site_words_of(host)
        lines = P.page_lines(markdown, site, title)
        leads: dict[int, int] = {}
        for x in lines:
            sig = None if P.ITEM_LINK.search(x.text) else _hash(P.signature(x.text))
            first = x.block not in leads
            if first:
                leads[x.block] = sig if sig is not None else 0
            yield key, host, x.no, x.verdict, sig, leads[x.block], _hash(x.path), first
        if P.title_has_more(title, P.headline(lines), site):
            yield key, host, 0, 1, None, 0, None, False

    return row


def line_table(results: DataFrame, streams: DataFrame) -> DataFrame:
    """All non-blank lines with the verdict of their form and place, written once, as votes and result both read it."""
    path = scratch_path(results.sparkSession, "p3-lines")
    map_rows(with_host(results, streams), _line_rows, LINES).write.parquet(path)
    return results.sparkSession.read.schema(LINES).parquet(path)


def furniture_lines(results: DataFrame, streams: DataFrame) -> DataFrame:
    """(result_id, line_no) of all lines that are not part of the main body; line 0 stands for the title."""
    lines = line_table(results, streams)
    per_host = lines.where("sig is not null").select("host", "sig", "result_id").distinct().groupBy("host", "sig").agg(F.count("*").alias("n"))
    pages = lines.groupBy("host").agg(F.count_distinct("result_id").alias("pages"))
    # One row for each path of the whole corpus, with its hosts and pages; what passes the share is
    # at most (lines of a page / ALL_SHARE) rows, whatever the size of the corpus.
    all_pages = pages.agg(F.sum("pages")).first()[0] or 0
    everywhere = (
        per_host.groupBy("sig").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("host") != "", 1).otherwise(F.col("n"))).alias("hosts"))
        .where(f"n >= {ALL_SHARE * all_pages} and n >= {ALL_PAGES} and hosts >= {ALL_HOSTS}")
        .select(F.col("sig").alias("lead"), F.lit(True).alias("everywhere"))
    )
    on_host = (
        per_host.where(f"host <> '' and n >= {HOST_PAGES}").join(pages, "host").where(f"n >= {HOST_SHARE} * pages")
        .select("host", F.col("sig").alias("lead"), F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"), F.lit(True).alias("on_host"))
    )
    # Votes on paths: a path is made of a few categories, so there are some thousands at most, whatever the corpus' size.
    votes = lines.where("first and verdict <> 2").groupBy("host", "path").agg(F.sum("verdict").alias("furniture"), F.count("*").alias("n"))
    of_all = votes.groupBy("path").agg((F.sum("furniture") / F.sum("n")).alias("all_share"))
    # Of hosts only those rows are needed that differ from what all hosts say.
    of_host = (
        votes.where(f"host <> '' and n >= {HOST_PAGES}").withColumn("host_share", F.col("furniture") / F.col("n"))
        .join(F.broadcast(of_all), "path").where("abs(host_share - all_share) > 0.1")
        .select("host", "path", "host_share", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt"))
    )
    salted = lines.withColumn("salt", F.pmod(F.col("result_id"), F.lit(SALTS)).cast("int"))
    share = F.coalesce("host_share", "all_share")
    furniture = F.when(share >= CLEAR, True).when(share <= 1 - CLEAR, False).otherwise(F.col("verdict") == 1)
    scored = salted.where("verdict <> 2 and line_no > 0").join(F.broadcast(of_all), "path", "left").join(of_host, ["host", "path", "salt"], "left").where(furniture)
    titles = lines.where("line_no = 0").select("result_id", "line_no")
    asked = salted.where("verdict = 2")
    voted = asked.join(F.broadcast(everywhere), "lead", "left").join(on_host, ["host", "lead", "salt"], "left").where("everywhere or on_host")
    return titles.unionByName(scored.select("result_id", "line_no")).unionByName(voted.select("result_id", "line_no"))


def main_bodies(results: DataFrame, furniture: DataFrame) -> DataFrame:
    """(result_id, headline, body): each page's article and its own headline, the furniture lines left out."""
    schema = T.StructType([T.StructField("result_id", T.LongType()), T.StructField("headline", T.StringType()), T.StructField("body", T.StringType())])
    out = furniture.groupBy("result_id").agg(F.collect_list("line_no").alias("out"))
    pages = results.where("converter = 'html' and markdown is not null").select("result_id", "markdown", "title").join(out, "result_id", "left")

    def make():
        def row(key, markdown, title, _key_out):
            drop = set(_key_out or ())
            kept, blank = [], True
            for no, line in enumerate(markdown.split("\n"), 1):
                if no in drop or not line.strip():
                    blank = blank or not line.strip() or bool(kept)
                    continue
                if kept and blank:
                    kept.append("")
                kept.append(line)
                blank = False
            head = P.HEADING.match(kept[0]) if kept else None
            yield key, head[1].strip() if head else (title if 0 not in drop else None), "\n".join(kept) + "\n" if kept else ""

        return row

    return map_rows(pages, make, schema)
