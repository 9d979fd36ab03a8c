"""Site-relative line deduplication: rows are pages grouped by host; a line that more than `ratio` of a host's pages
hold, and at least `min_pages` of them, is boilerplate of that host and goes from its pages. By default these are two,
so that the ratio decides on hosts of any size, and a page by itself keeps its lines.

A host has at most (lines on a page) / ratio boilerplate lines, so that a host's list of their hashes is bounded
whatever the number of its pages; counts are added up before the shuffle, so that a hot host or line costs no more
than any other. Where all lists together are small they are broadcast, else they meet pages by host and salt.

Defined cases: lines are what stands between line feeds, compared exactly; lines without a word are never counted nor
removed. A line counts once for a page. Pages without a host or text stay as they are. A page may lose all its lines;
its text is then empty. Each of several equal rows is a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, saved, table

RATIO = 0.05
#: What one page holds repeats nothing.
MIN_PAGES = 2
#: Boilerplate lines of all hosts up to which their hashes (16 bytes each) are broadcast.
BROADCAST_LINES = 200_000
SALTS = 32
_WORD = r"[^\x20\x09-\x0D]"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def host_of(url: Column) -> Column:
    """The host of a URL, for tables of pages."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, and lines: the keys of its boilerplate lines."""
    own = pages.select(host.alias("host"), text.alias("text")).where(F.col("host").isNotNull())
    lines = own.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).where(F.col("line").rlike(_WORD))
    counts = lines.select("host", _key(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    totals = own.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.col("pages") * F.lit(ratio))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def remove_lines(pages: DataFrame, host: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with their text cleaned, and `lines` and `removed` after the prefix that fresh(pages) gives: its lines with
    a word, and how many of them went."""
    p = fresh(pages)
    found = saved(boilerplate(pages, host, F.col(text), ratio, min_pages))
    total = found.agg(F.sum(F.size("lines"))).first()[0] or 0
    found = found.select(F.col("host").alias(f"{p}host"), F.col("lines").alias(f"{p}bad"))
    marked = pages.withColumn(f"{p}host", host)
    if total <= BROADCAST_LINES:
        joined = marked.join(F.broadcast(found), f"{p}host", "left")
    else:
        salted = found.withColumn(f"{p}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns]), F.lit(SALTS)).cast("int")
        joined = marked.withColumn(f"{p}salt", salt).join(salted, [f"{p}host", f"{p}salt"], "left").drop(f"{p}salt")
    split, bad = F.split(F.col(text), "\n", -1), F.col(f"{p}bad")
    kept = F.filter(split, lambda x: ~F.array_contains(bad, _key(x)))
    worded = lambda lines: F.size(F.filter(lines, lambda x: x.rlike(_WORD)))
    known = bad.isNotNull() & F.col(text).isNotNull()
    out = joined.withColumn(f"{p}kept", F.when(known, kept)).withColumn(f"{p}lines", F.coalesce(worded(split), F.lit(0)).cast("long"))
    out = out.withColumn(f"{p}removed", F.when(known, F.col(f"{p}lines") - worded(F.col(f"{p}kept"))).otherwise(0).cast("long"))
    changed = F.col(f"{p}removed") > 0
    return out.withColumn(text, F.when(changed, F.array_join(f"{p}kept", "\n")).otherwise(F.col(text))).drop(f"{p}host", f"{p}bad", f"{p}kept")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """documents with lines removed and n_chars brought up to date; their source is the host."""
    out = remove_lines(docs, F.col("source"))
    if "n_chars" in docs.columns:
        changed = F.col(f"{fresh(docs)}removed") > 0
        out = out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return remove_lines(docs, F.col("source")).select(
        "doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT source, unnest(list_distinct(lines)) AS line FROM d WHERE source IS NOT NULL),
c AS (SELECT source, line, count(*) AS n FROM l WHERE regexp_matches(line, '{_WORD}') GROUP BY 1, 2),
t AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY 1),
b AS (SELECT source, list(line) AS bad FROM c JOIN t USING (source) WHERE n >= {MIN_PAGES} AND n > pages * CAST({RATIO} AS DOUBLE) GROUP BY 1),
k AS (SELECT doc_id, text, lines, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM d LEFT JOIN b USING (source))
SELECT doc_id, CAST(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '{_WORD}'))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM k
"""
