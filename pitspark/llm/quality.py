"""Quality rules with thresholds that adapt to each language and source.

Each document gets base statistics and a few ratios in parts per ten thousand. The ratios' distribution in each (language,
source) is kept as a mergeable quantile sketch: counts in logarithmic buckets of fixed relative error, which add up exactly
in any order. A ratio may exceed its group's upper quartile by SPREAD times the quartile's distance from the median, both
read from the sketch; there is no fixed cutoff. Limits of a group are drawn towards those of its language, and these towards
those of all documents, the more the fewer documents it has. Verdicts come from joining the limits to the documents.

Texts are taken apart in Python workers, a text at a time: strings and arrays made of them in the JVM would let its heap grow
to the limit, as fast as they become garbage.
"""

from __future__ import annotations

import io
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage, table, unused

#: Relative error of the sketch's quantiles.
ALPHA = 0.02
GAMMA = (1 + ALPHA) / (1 - ALPHA)
SPREAD = 15.0
#: Documents as many as which the wider group's limit weighs.
WEIGHT = 200
WINDOW = 5
#: Ratios that must not be unusually high: signs that are neither letters nor digits, capitals, words equal to the one before.
RATIOS = ("signs", "capitals", "stutter")
#: Added to what a ratio is of, so that a few characters of a short text don't decide.
SMOOTH = {"signs": 50, "capitals": 50, "stutter": 10}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What is counted in each text; signs include the symbols.
COUNTS = (*BASE, "signs", "upper", "letters", "stutter")
#: Kinds of characters: ASCII white space, symbols, other signs, capitals, other letters, and marks, numbers and other separators.
SPACE, SYMBOL, SIGN, CAPITAL, LETTER, OTHER = range(6)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point."""
    by_class = {"L": LETTER, "M": OTHER, "N": OTHER, "Z": OTHER}
    kind = np.fromiter((CAPITAL if (c := unicodedata.category(chr(k))) == "Lu" else by_class.get(c[0], SIGN) for k in range(0x110000)), np.uint8, 0x110000)
    kind[[*b"#*$%&|<>"]] = SYMBOL
    kind[[*b" \t\n\v\f\r"]] = SPACE
    return kind


def character_kinds(text: bytes, size: int = 1 << 20) -> np.ndarray:
    """How many characters of each kind UTF-8 bytes hold, counted in parts of size characters."""
    chars, n = text.decode("utf-8", "replace"), np.zeros(OTHER + 1, np.int64)
    for k in range(0, len(chars), size):
        n += np.bincount(_kinds()[np.frombuffer(chars[k : k + size].encode("utf-32-le"), np.uint32)], minlength=OTHER + 1)
    return n


def text_hashes(text: bytes, size: int = 1 << 20) -> np.ndarray:
    """The words' 64-bit hashes, in order; equal in one process only. Words are split in parts of about size bytes that end at white space."""
    out, at = [np.zeros(0, np.int64)], 0
    while at < len(text):
        end = _BREAK.search(text, at + size)
        to = end.end() if end else len(text)
        found = text[at:to].split()  # of bytes: at ASCII white space only
        out.append(np.fromiter(map(hash, found), np.int64, len(found)))
        at = to
    return np.concatenate(out)


def repeated_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text, the first one included."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    h = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        key = h[:n].copy()
        for j in range(1, window):
            key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[j : n + j]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int32)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    n, seen = 0, set()
    for line in io.BytesIO(text):
        if not line.isspace():
            n += 1
            seen.add(line.removesuffix(b"\n"))
    return n - len(seen)


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text, as UTF-8 bytes. Null counts as empty."""
    text = text or b""
    h, kinds = text_hashes(text), character_kinds(text)
    n = (len(h), kinds.sum() - kinds[SPACE], kinds[SYMBOL], duplicate_lines(text), repeated_words(h))
    return (*map(int, n), int(kinds[SYMBOL] + kinds[SIGN]), int(kinds[CAPITAL]), int(kinds[CAPITAL] + kinds[LETTER]), int((h[1:] == h[:-1]).sum()))


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))
def _text_counts(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in parts:
        yield pd.DataFrame([text_counts(x) for x in texts], columns=COUNTS, dtype="int64")


def with_stats(docs: DataFrame, name: str, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs with a struct column of the given name: base statistics, base_failed, ratios and the group. Null text counts as empty."""
    out = docs.withColumn(name, _text_counts(F.col(text_col).cast("string").cast("binary")))
    b = lambda n: F.col(name)[n]
    part = lambda r, x, of: F.floor(x * 10000 / (of + SMOOTH[r])).cast("long").alias(r)
    ratios = F.struct(part("signs", b("signs"), b("word_chars")), part("capitals", b("upper"), b("letters")), part("stutter", b("stutter"), b("n_words")))
    failed = (b("n_words") < 10) | (100 * b("n_repeat_words") > 20 * b("n_words"))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    return out.withColumn(name, F.struct(*[b(n) for n in BASE], failed.alias("base_failed"), ratios.alias("ratios"), *group))


def _bucket(value: Column) -> Column:
    """0 for 0, else 1 and up: bucket b holds the integers from GAMMA ** (b - 2) (not included) to GAMMA ** (b - 1)."""
    return F.when(value <= 0, 0).otherwise(1 + F.ceil(F.log(value.cast("double")) / log(GAMMA))).cast("int")


def sketches(stats: DataFrame, name: str) -> DataFrame:
    """(lang, source, ratio, bucket, n): a row for each bucket in use. Sketches merge by adding n. Documents that fail the base rule don't count."""
    q = F.col(name)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _bucket(q["ratios"][r]).alias("bucket")) for r in RATIOS])).alias("x")
    sound = stats.filter(~q["base_failed"])
    return sound.select(q["lang"].alias("lang"), q["source"].alias("source"), each).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def _limits(sketch: DataFrame, by: list[str], tag: str) -> DataFrame:
    """(by..., ratio, <tag>_rows, <tag>_limit) from merged sketches, some hundred buckets a group at most: read as arrays, without windows' sorters."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = merged.groupBy(*by, "ratio").agg(F.sum("n").alias("rows"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))

    def at(q: float) -> Column:
        """The least bucket that holds the share q together with those below: the last one before which it isn't reached."""
        start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).alias("bucket"))
        step = lambda a, x: F.struct((a["upto"] + x["n"]).alias("upto"), F.when(a["upto"] < F.ceil(F.col("rows") * q), x["bucket"]).otherwise(a["bucket"]).alias("bucket"))
        bucket = F.aggregate("counts", start, step)["bucket"]
        return F.when(bucket == 0, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), bucket - 1) / (GAMMA + 1))

    q2, q3 = at(0.5), at(0.75)
    # one bucket is the least distance that the sketch can tell
    limit = q3 + SPREAD * F.greatest(q3 - q2, q3 * (GAMMA - 1))
    return whole.select(*by, "ratio", F.col("rows").alias(f"{tag}_rows"), limit.alias(f"{tag}_limit"))


def thresholds(sketch: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """(lang, source, limits): the highest accepted value of each ratio, by group, drawn towards those of its language and of all documents."""
    own, lang, whole = _limits(sketch, ["lang", "source"], "own"), _limits(sketch, ["lang"], "lang"), _limits(sketch, [], "all")
    joined = own.join(lang, ["lang", "ratio"]).join(whole, "ratio")
    wide = (F.col("lang_rows") * F.col("lang_limit") + weight * F.col("all_limit")) / (F.col("lang_rows") + weight)
    limit = F.floor((F.col("own_rows") * F.col("own_limit") + weight * wide) / (F.col("own_rows") + weight)).cast("long")
    return joined.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", limit))).alias("limits"))


def judge(stats: DataFrame, name: str, limits: DataFrame, verdict: str) -> DataFrame:
    """stats with a boolean column verdict. The join's small side has a row a group; AQE broadcasts it while it is small and splits hot groups beyond."""
    lang, source, most = unused(stats, "_lang", "_source", "_limits")
    small = limits.select(F.col("lang").alias(lang), F.col("source").alias(source), F.col("limits").alias(most))
    q = F.col(name)
    out = stats.join(small, (q["lang"] == F.col(lang)) & (q["source"] == F.col(source)), "left")
    fine = ~q["base_failed"]
    for r in RATIOS:
        fine = fine & F.coalesce(q["ratios"][r] <= F.element_at(most, F.lit(r)), F.lit(True))  # a group without limits has no sound documents
    return out.withColumn(verdict, fine).drop(lang, source, most)


@contextmanager
def short_reads(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Parquet readers hold at most so many rows at once for what is written within; no result depends on it.

    Arrays for some thousand texts take more than ten MB each, and G1 extends the heap where it finds no free stretch as long.
    """
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that pass, columns unchanged, whatever names other columns have. Nulls, empty and repeated rows: see op3_quality_rules.

    Statistics are computed once and written beside the rows; the sketches read that column only. The limits are written too,
    so the planner knows their true size: it broadcasts them below its threshold, and no text is shuffled.
    """
    small_batches(docs.sparkSession)
    name, verdict = unused(docs, "_stats", "_kept")
    with short_reads(docs.sparkSession):
        stats = stage(with_stats(docs, name), "stats")
    return judge(stats, name, stage(thresholds(sketches(stats, name)), "limits"), verdict).filter(F.col(verdict)).select(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of all documents.

    Null and empty texts have no words and fail the base rule; null language or source is a group of its own; repeated rows
    count as often as they occur; a ratio equal to its limit passes; an empty table gives an empty result.
    """
    small_batches(spark)
    with short_reads(spark):
        stats = stage(with_stats(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "stats").select("doc_id", "stats"), "stats")
    out = judge(stats, "stats", stage(thresholds(sketches(stats, "stats")), "limits"), "kept")
    return out.select("doc_id", *[f"stats.{n}" for n in BASE], "stats.base_failed", "kept")


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
s AS (SELECT doc_id, count(*) FILTER (same) AS stutter FROM (SELECT doc_id, x = lag(x) OVER (PARTITION BY doc_id ORDER BY k) AS same FROM u) GROUP BY 1),
g AS (
  SELECT doc_id, k, string_agg(x, ' ') OVER five AS g, count(*) OVER five AS n FROM u
  WINDOW five AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, k FROM g WHERE n = {WINDOW} QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM r, range({WINDOW}) AS x(j) GROUP BY 1),
b AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\p{{Z}}\s\x0B]+', '', 'g')) AS signs,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(t, '[^\p{{L}}]+', '', 'g')) AS letters, coalesce(stutter, 0) AS stutter
  FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    [signs * 10000 // (word_chars + {SMOOTH['signs']}), upper * 10000 // (letters + {SMOOTH['capitals']}), stutter * 10000 // (n_words + {SMOOTH['stutter']})] AS ratios FROM b),
v AS (
  SELECT lang, source, i, CASE WHEN v <= 0 THEN 0 ELSE 2 * pow({GAMMA!r}::DOUBLE, ceil(ln(v) / ln({GAMMA!r}::DOUBLE))) / ({GAMMA!r}::DOUBLE + 1) END AS v
  FROM (SELECT lang, source, unnest(ratios) AS v, generate_subscripts(ratios, 1) AS i FROM f WHERE NOT base_failed)),
q AS (
  SELECT lang, source, i, count(*) AS n, list_sort(list(v)) AS s, s[CAST(ceil(n * 0.5) AS BIGINT)] AS q2, s[CAST(ceil(n * 0.75) AS BIGINT)] AS q3,
    q3 + {SPREAD} * greatest(q3 - q2, q3 * ({GAMMA!r}::DOUBLE - 1)) AS most
  FROM v GROUP BY GROUPING SETS ((lang, source, i), (lang, i), (i))),
l AS (
  SELECT o.lang, o.source, list(CAST(floor((o.n * o.most + {WEIGHT} * ((g.n * g.most + {WEIGHT} * a.most) / (g.n + {WEIGHT}))) / (o.n + {WEIGHT})) AS BIGINT) ORDER BY o.i) AS limits
  FROM q o JOIN q g ON g.lang = o.lang AND g.i = o.i AND g.source IS NULL JOIN q a ON a.i = o.i AND a.lang IS NULL WHERE o.source IS NOT NULL GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(ratios[1] <= limits[1] AND ratios[2] <= limits[2] AND ratios[3] <= limits[3], true) AS kept
FROM f LEFT JOIN l USING (lang, source)
"""
