"""Cross-site boilerplate lines: how many distinct sites a line stands on, by HyperLogLog sketches.

Sketches of the site are built for each line hash and merge by aggregation. An estimate that clears the threshold by the
sketch's error decides at once; lines near it get an exact distinct count. Lines at or over the threshold are removed from
all documents.

A line spreads by being put on pages, not by its whole page being copied. So the copies of a document, on however many
sites, count as one site for each of their lines: otherwise a text that many sites copied would vanish altogether, where
the near-duplicate stage is to keep one of them.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, table, unused

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Documents are copies if their lines are the same, or those of LONG characters or more where there are LONG_LINES of them.
LONG, LONG_LINES = 100, 3
_LG_K = 10


def _line(raw: Column) -> Column:
    return F.btrim(raw, F.lit(" \t\r\x0b\x0c"))


def _keys(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _lines(docs: DataFrame, site_col: str, text_col: str) -> DataFrame:
    """(site, h1, h2): the lines of each document, with one site for all copies of a document."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("\x00"))
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n"), _line), lambda x: x != "")
    long_ = F.filter("lines", lambda x: F.length(x) >= LONG)
    many = F.size(long_) >= LONG_LINES
    key = lambda seed: F.when(many, F.xxhash64(F.lit(seed + 1), long_)).otherwise(F.xxhash64(F.lit(seed), "lines"))
    keyed = docs.select(site.alias("site"), lines.alias("lines")).filter(F.size("lines") > 0).select("site", "lines", key(1).alias("c1"), key(3).alias("c2"))
    copies = keyed.groupBy("c1", "c2").agg(F.min("site").alias("one"), F.max("site").alias("other")).filter("one < other").drop("other")
    # written, so the planner knows its size: a row for each document that stands on several sites
    rows = keyed.join(stage(copies, "copies"), ["c1", "c2"], "left").select(F.coalesce("one", "site").alias("site"), F.explode(F.array_distinct("lines")).alias("line"))
    return rows.select("site", *_keys(F.col("line")))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(h1, h2, n_sites) of the lines on min_sites sites or more; n_sites is exact near the threshold and estimated beyond.

    Lines are compared without white space at their ends; blank lines don't count. A null site is a site of its own.
    """
    lines = stage(_lines(docs, site_col, text_col), "lines")
    near = ceil(3 * 1.04 / sqrt(2**_LG_K) * min_sites) + 1
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", _LG_K)).alias("n_sites"))
    spread = stage(spread.filter(F.col("n_sites") >= min_sites - near), "spread")
    close = spread.filter(F.col("n_sites") < min_sites + near).select("h1", "h2")
    exact = lines.join(close, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_sites"))
    return stage(spread.filter(F.col("n_sites") >= min_sites + near).unionByName(exact.filter(F.col("n_sites") >= min_sites)), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the boilerplate lines cut out of the text, and one column ``line_dedup`` (n_lines, n_removed) more.

    Null texts stay null; a text without such lines stays as it is, byte for byte; a text of nothing else becomes empty.
    Repeated rows are treated alike; an empty table stays empty. An input column named line_dedup is replaced; other columns
    are carried, whatever their names.
    """
    found = boilerplate_lines(docs, min_sites, site_col, text_col)
    # by document, not by text alone: copies of one text spread over all tasks
    d1, d2, cut = unused(docs, "_d1", "_d2", "_cut")
    k1, k2 = F.coalesce(F.xxhash64(id_col), F.lit(0)), F.xxhash64(text_col)
    here = docs.select(k1.alias(d1), k2.alias(d2), F.explode(F.array_distinct(F.transform(F.split(F.col(text_col), "\n"), _line))).alias("line")).filter("line != ''")
    hits = here.select(d1, d2, *_keys(F.col("line"))).join(found.select("h1", "h2"), ["h1", "h2"]).groupBy(d1, d2).agg(F.collect_set(F.struct("h1", "h2")).alias(cut))

    lines = F.split(F.col(text_col), "\n", -1)
    keep = F.filter(lines, lambda x: (_line(x) == "") | ~F.array_contains(F.col(cut), F.struct(*_keys(_line(x)))))
    out = docs.withColumns({d1: k1, d2: k2}).join(hits, [d1, d2], "left")
    hit = F.col(cut).isNotNull()
    mark = F.struct(F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(hit, F.size(lines) - F.size(keep)).otherwise(0).cast("long").alias("n_removed"))
    new_text = F.when(hit, F.array_join(keep, "\n")).otherwise(F.col(text_col))
    return out.select(*[new_text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "line_dedup"], mark.alias("line_dedup"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without cross-site boilerplate lines."""
    out = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, text, string_split(text, chr(10)) AS raw,
    list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS lines
  FROM documents WHERE text IS NOT NULL),
k AS (
  SELECT *, list_filter(lines, lambda x: x <> '') AS here, list_filter(lines, lambda x: length(x) >= 100) AS long FROM l),
c AS (SELECT *, CASE WHEN len(long) >= 3 THEN long ELSE here END AS copied, len(long) >= 3 AS by_long FROM k),
s AS (SELECT *, min(site) OVER (PARTITION BY copied, by_long) AS one FROM c),
b AS (
  SELECT line FROM (SELECT unnest(here) AS line, one FROM s) GROUP BY line HAVING count(DISTINCT one) >= 10),
t AS (SELECT doc_id, unnest(raw) AS raw, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM l),
d AS (
  SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
    coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (b.line IS NULL), '') AS kept
  FROM t LEFT JOIN b USING (line) GROUP BY doc_id)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(CASE WHEN n_removed > 0 THEN kept ELSE o.text END) AS text_sha256
FROM documents o LEFT JOIN d USING (doc_id)
"""
