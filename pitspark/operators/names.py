"""Company names: normal form and fuzzy resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: words of corporate form
FORMS = ["inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "lllp", "sa", "ag", "nv", "se", "ab", "holdings", "holding", "group", "the", "and", "of", "&"]


def normalize(name: Column) -> Column:
    """Lower case, letters and digits, without words of corporate form."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9 ]", " "), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*FORMS)), " ")


# fixed values: words that a company's name shares with many
COMMON = ["inc", "corp", "corporation", "ltd", "plc", "co", "the", "company", "therapeutics", "pharmaceuticals", "pharma", "sciences", "holdings", "group"]


def match_token(title: Column) -> Column:
    """The first word of three letters or more that tells a company's name from others; null if there is none."""
    words = F.split(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", " "), " +")
    return F.get(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*COMMON)), F.lit(0))


def _stems(name: Column) -> Column:
    """What a shorter name must equal to match loosely: the prefixes of four letters or more at a word's end, and the name without its last one to three letters if five are left."""
    words = F.split(name, " ")
    at_word = F.filter(F.transform(words, lambda w, i: F.array_join(F.slice(words, F.lit(1), i + 1), " ")), lambda x: (F.length(x) >= 4) & (F.length(x) < F.length(name)))
    glued = F.filter(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.substring(name, F.lit(1), F.length(name) - k)), lambda x: F.length(x) >= 5)
    return F.array_union(at_word, glued)


def resolve(sponsors: DataFrame, companies: DataFrame) -> DataFrame:
    """(sponsor, cik): exact normal form, else a shared prefix at a word's end, else one that only lacks up to three letters; the longest company name wins.

    A loose match is an equality of the shorter name with a stem of the longer. Of the companies that share a stem only the
    best is joined, so rows grow with the names, not with their pairs.
    """
    s = sponsors.select("sponsor", normalize(F.col("sponsor")).alias("s")).filter("s <> ''").distinct()
    c = companies.groupBy(normalize(F.col("name")).alias("c")).agg(F.min("cik").alias("cik")).filter("c <> ''")
    exact = s.join(c, F.col("s") == F.col("c")).select("sponsor", "cik")
    rest = s.join(exact.select("sponsor"), "sponsor", "left_anti")
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.length("c")), "c"))
    of_longer = c.select(F.explode(_stems(F.col("c"))).alias("stem"), "c", "cik").withColumn("rn", first("stem")).filter("rn = 1").drop("rn")
    longer = rest.join(of_longer, F.col("s") == F.col("stem")).select("sponsor", "c", "cik")
    shorter = rest.select("sponsor", F.explode(_stems(F.col("s"))).alias("stem")).join(c, F.col("stem") == F.col("c")).select("sponsor", "c", "cik")
    loose = longer.unionByName(shorter).withColumn("rn", first("sponsor")).filter("rn = 1").select("sponsor", "cik")
    return exact.unionByName(loose)


def norm_ticker(raw: Column) -> Column:
    first = F.element_at(F.filter(F.split(F.upper(raw), r"\s+"), lambda w: w != ""), 1)
    return F.translate(F.regexp_replace(first, r"[^A-Z0-9.\-]", ""), ".", "-")


def reconstruct_membership(current: DataFrame, changes: DataFrame) -> DataFrame:
    """(ticker, added, removed) from today's members (ticker, added) and a change log (day, kind, ticker): a gone name gets its earliest removal, a missing start its first addition."""
    added = changes.filter("kind = 'added'").groupBy("ticker").agg(F.min("day").alias("first_added"))
    gone = changes.filter("kind = 'removed'").join(current, "ticker", "left_anti").groupBy("ticker").agg(F.min("day").alias("removed"))
    now = current.select("ticker", "added", F.lit(None).cast("date").alias("removed"))
    rows = now.unionByName(gone.select("ticker", F.lit(None).cast("date").alias("added"), "removed"))
    return rows.join(added, "ticker", "left").select("ticker", F.coalesce("added", "first_added").alias("added"), "removed")
