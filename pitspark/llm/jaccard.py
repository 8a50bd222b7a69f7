"""Near-duplicate join by chosen paths.

A document is its set of five-word shingles. Documents of equal sets are one class. Each class carries min-hash tokens of
its set, in which two classes share a token at each place with the probability of their Jaccard similarity. A run starts a
class in one bucket for each of a few sampled tokens; a bucket that is too large is split on further tokens, chosen by its
path; small buckets are compared by brute force. Runs repeat until two classes at the threshold meet in some bucket with
the target recall. A bucket that doesn't fall apart (its members are near copies of one another) is compared in blocks, so
no task holds more than two blocks.

Buckets only nominate: they link classes by a lenient estimate from 128 tokens, and the components of these links are the
candidates. Then all pairs within a component are decided on the whole sets, again in blocks, and only counts and enough links
to span each block leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import small_batches, stage, table, unstage, unused, word_hashes
from .graph import components

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TOKENS, PER_RUN, DEPTH = 128, 2, 3
#: The estimate from 128 tokens has a deviation of 0.035 at the threshold; this margin is over four of them.
MARGIN = 0.16
#: Classes compared at once by estimate, and on whole sets.
BUCKET, BLOCK = 512, 256
#: The bits for each row of the filter that sifts rows before a join, how many of them it sets, those of one bitmap, and its size (a power of two) at most, 32 MB.
BITS, PLACES, WORD_BITS, MOST_BITS = 16, 4, 15, 28


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold is found with the given recall, if its path splits depth times in each run."""
    once = (1 - (1 - threshold) ** PER_RUN) ** depth
    return ceil(log(1 - recall) / log(1 - once))


RUNS = runs_for()
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 2**64, TOKENS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, TOKENS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(29))


def shingles(hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all runs of size words; a shorter text is one shingle of all its words."""
    h = np.asarray(hashes, dtype=np.int64).view(np.uint64)
    if len(h) == 0:
        return h
    width = min(size, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        key = np.full(n, np.uint64(width))
        for j in range(width):
            key = _mix(key) + h[j : n + j]
    return np.unique(_mix(key))


def tokens(found: np.ndarray) -> np.ndarray:
    """The min-hash token of each place."""
    out = np.full(TOKENS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for part in range(0, len(found), 2048):
            x = found[part : part + 2048]
            out = np.minimum(out, _mix(x[None, :] * _MUL[:, None] + _ADD[:, None]).min(1))
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, set_id (null without words), n_shingles, roots (whole tokens of the runs' first buckets), sig (a byte of each token)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for words in df.pop("words"):
                s = shingles(words)
                if not len(s):
                    out.append((None, 0, None, None))
                    continue
                t = tokens(s)
                out.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), t[: RUNS * PER_RUN].view(np.int64).tolist(), (t & np.uint64(255)).astype(np.uint8).tobytes()))
            yield pd.concat([df, pd.DataFrame(out, columns=["set_id", "n_shingles", "roots", "sig"], index=df.index)], axis=1)

    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes(F.col("text")).alias("words"))
    return rows.mapInPandas(run, "doc_id long, text_key long, set_id binary, n_shingles int, roots array<long>, sig binary")


def in_blocks(rows: DataFrame, by: str, size: str, limit: int, member: str) -> DataFrame:
    """rows, each in every group (unit) in which it meets a block: groups of at most limit rows are one unit; others are dealt into blocks, a unit for each pair of blocks."""
    n = F.ceil(F.col(size) / limit)
    block = F.pmod(F.xxhash64(member, F.lit(3)), n)
    out = rows.withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    low, high = F.least("block", "with"), F.greatest("block", "with")
    return out.withColumn("cross", low != high).withColumn("unit", F.xxhash64(by, low, high)).drop("with")


def by_unit(rows: DataFrame, work: Callable[[pd.DataFrame], list], schema: str, names: list[str], order: str, columns: list[str | Column] | None = None) -> DataFrame:
    """work() on each unit's rows; units are small and many, so they stream through a sorted partition. columns: what work() gets, made of the rows after the shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, out = None, []
        for df in parts:
            df = df if rest is None else pd.concat([rest, df], ignore_index=True)
            unit = df["unit"].to_numpy()
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            for a, b in zip(starts, starts[1:], strict=False):
                out += work(df.iloc[a:b])
            rest = df.iloc[starts[-1] :]
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rest is not None and len(rest):
            out += work(rest)
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition("unit").sortWithinPartitions("unit", order).select(*columns or ["*"]).mapInPandas(run, schema)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what all links (a, b) connect: from each node to the first of its component."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(top(x), x) for x in range(n) if top(x) != x]


def _nominate(threshold: float) -> Callable[[pd.DataFrame], list]:
    least = int((threshold - MARGIN) * TOKENS)

    def work(df: pd.DataFrame) -> list:
        ids, sizes = df["set_id"].tolist(), df["n_shingles"].to_numpy()
        sig = np.frombuffer(b"".join(df["sig"]), np.uint8).reshape(len(ids), TOKENS)
        block = df["block"].to_numpy() if df["cross"].iloc[0] else None
        found_a, found_b = [], []
        for i in range(len(ids) - 1):
            near = (sig[i + 1 :] == sig[i]).sum(1) >= least
            near &= np.minimum(sizes[i + 1 :], sizes[i]) >= threshold * np.maximum(sizes[i + 1 :], sizes[i])
            if block is not None:
                near &= block[i + 1 :] != block[i]
            at = np.flatnonzero(near)
            found_a.append(np.full(len(at), i))
            found_b.append(at + i + 1)
        if not found_a:
            return []
        return [(ids[a], ids[b]) for a, b in _forest(len(ids), np.concatenate(found_a), np.concatenate(found_b)) if ids[a] != ids[b]]

    return work


def sifted(rows: DataFrame, wanted: DataFrame, on: tuple[str, ...] = ("doc_id", "text_key"), of: tuple[str, ...] = ("of_doc", "of_text")) -> DataFrame:
    """rows without those whose columns `on` no row of wanted can equal in its columns `of`; few others stay.

    Broadcast bitmaps tell, so rows that don't match are not shuffled. Each key sets a few bits of one bitmap. Their size is
    bounded whatever wanted's: beyond some 17 million rows more false alarms stay, which the join drops.
    """
    bits = min(MOST_BITS, max(WORD_BITS + 1, (BITS * wanted.count()).bit_length()))
    word, bitmap, hashed = unused(rows, "_word", "_bitmap", "_hashed")
    number = lambda by: F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(1 << bits - WORD_BITS))
    places = [F.shiftrightunsigned(hashed, WORD_BITS * k).bitwiseAND((1 << WORD_BITS) - 1) for k in range(PLACES)]
    marks = wanted.select(number(of).alias(word), F.xxhash64(*of, F.lit(7)).alias(hashed)).select(word, F.explode(F.array(*places)).alias(hashed))
    marks = marks.groupBy(word).agg(F.bitmap_construct_agg(hashed).alias(bitmap))
    near = rows.withColumn(hashed, F.xxhash64(*on, F.lit(7))).withColumn(word, number(on)).join(F.broadcast(marks), word)
    for k in places:
        byte = F.conv(F.hex(F.substring(bitmap, (k / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        near = near.filter(byte.bitwiseAND(F.pow(F.lit(2), k % 8).cast("int")) != 0)
    return near.select(*rows.columns)


def _level(rows: DataFrame) -> DataFrame:
    """rows with the size of their bucket and a sum that tells its members, without buckets of one. Sizes are staged, so both sides of the join are plain shuffles whose hot buckets AQE can split."""
    like = F.sum(F.shiftright(F.xxhash64("set_id"), 24)).alias("like")
    sizes = stage(rows.groupBy("bucket").agg(F.count("*").alias("size"), like).filter("size > 1"), "sizes")
    found = stage(sifted(rows, sizes, ("bucket",), ("bucket",)).join(sizes, "bucket"), "buckets")
    unstage(sizes)
    return found


def nominated(classes: DataFrame, threshold: float = THRESHOLD, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links by estimate that connect every two classes at the threshold, with the target recall."""
    start = classes.select("set_id", F.posexplode("roots").alias("place", "root")).select("set_id", F.xxhash64("place", "root").alias("bucket"), F.lit(2**50).alias("parent"))
    level, leaves, levels = _level(start), [], []
    for depth in range(DEPTH + 1):
        levels.append(level)
        # dense: splitting the parent hardly helped
        done = (F.col("size") <= bucket) | (F.col("size") * 10 >= F.col("parent") * 7) if depth < DEPTH else F.lit(True)
        # buckets of the same classes, which near copies share in many runs, are one
        leaves.append(level.filter(done).select("set_id", F.xxhash64("like", "size").alias("bucket"), "size"))
        large = level.filter(~done)
        if depth == DEPTH or not large.limit(1).count():
            break
        split = large.join(sifted(classes.select("set_id", "sig"), large, ("set_id",), ("set_id",)), "set_id").withColumn("j", F.explode(F.array(*[F.lit(j) for j in range(PER_RUN)])))
        place = F.pmod(F.xxhash64("bucket", "j"), F.lit(TOKENS)).cast("int")
        split = stage(split.withColumn("place", place).select("set_id", F.xxhash64("bucket", "place", F.expr("substring(sig, place + 1, 1)")).alias("bucket"), F.col("size").alias("parent")), "split")
        level = _level(split)
        unstage(split)
    rows = leaves[0]
    for more in leaves[1:]:
        rows = rows.unionByName(more)
    sigs = sifted(classes.select("set_id", "n_shingles", "sig"), rows, ("set_id",), ("set_id",))
    rows = rows.groupBy("set_id").agg(F.collect_set(F.struct("bucket", "size")).alias("leaves"))
    rows = rows.join(sigs, "set_id").select("set_id", "n_shingles", "sig", F.inline("leaves"))
    units = in_blocks(rows, "bucket", "size", bucket, "set_id").select("unit", "set_id", "n_shingles", "sig", "block", "cross")
    found = stage(by_unit(units, _nominate(threshold), "a binary, b binary", ["a", "b"], "set_id").distinct(), "nominated")
    for x in levels:
        unstage(x)
    return found


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.int64)
    if m <= 4:
        for i in range(m):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[col] > 1
    owner, col = owner[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        a, b = np.searchsorted(col, (first, first + 4096))
        part = np.zeros((m, 4096), np.float32)
        part[owner[a:b], col[a:b] - first] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _decide(threshold: float) -> Callable[[pd.DataFrame], list]:
    def work(df: pd.DataFrame) -> list:
        df = df.drop_duplicates("set_id")  # repeated rows of a document
        ids, docs = df["set_id"].tolist(), df["n_docs"].to_numpy()
        sets = [shingles(w) for w in df["words"]]
        n = np.array([len(s) for s in sets])
        both = intersections(sets)
        linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if df["cross"].iloc[0]:
            block = df["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        out = [(ids[i], None, int(docs @ linked[i]), int(linked[i].sum())) for i in np.flatnonzero(linked.any(1))]
        a, b = np.nonzero(np.triu(linked))
        return out + [(ids[x], ids[y], 0, 0) for x, y in _forest(len(ids), a, b)]

    return work


def _first(doc_id: str = "doc_id", text_key: str = "text_key") -> Column:
    """The order in which a class chooses the row that stands for it: ids that are null come last."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("doc_id"), F.col(text_key).alias("text_key"))


def classified(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, set_id, and for rows with words copy_of, head (each the row that stands for the equal sets, and for the class) and n_links."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stage(sketched(docs), "sketched")
    found = marked.filter("set_id is not null").groupBy("set_id").agg(F.min(_first()).alias("first"), F.count("*").alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("roots").alias("roots"), F.first("sig").alias("sig"))
    classes = stage(found, "classes")
    links = nominated(classes, threshold)
    rough = components(links)
    unstage(links)
    sizes = rough.groupBy("label").agg(F.count("*").alias("size"))
    members = rough.join(sizes, "label").join(sifted(classes.select(F.col("set_id").alias("node"), "first", "n_docs"), rough, ("node",), ("node",)), "node")
    members = stage(members.select("node", "label", "size", "n_docs", F.col("first.doc_id").alias("of_doc"), F.col("first.text_key").alias("of_text")), "members")
    # most texts have no near copies, so they are not shuffled
    texts = sifted(docs.withColumn("text_key", F.xxhash64("text")), members).join(members, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")))
    # texts are dealt to the units: they take less than their sets
    units = in_blocks(texts.select(F.col("node").alias("set_id"), "label", "size", "n_docs", "text"), "label", "size", BLOCK, "set_id").select("unit", "set_id", "n_docs", "text", "block", "cross")
    columns = ["unit", "set_id", "n_docs", "block", "cross", word_hashes(F.col("text")).alias("words")]
    decided = stage(by_unit(units, _decide(threshold), "set_id binary, other binary, n_docs long, n_sets long", ["set_id", "other", "n_docs", "n_sets"], "set_id", columns), "decided")
    counts = decided.filter("other is null").groupBy("set_id").agg(F.sum("n_docs").alias("linked"))
    final = components(decided.filter("other is not null").select(F.col("set_id").alias("a"), F.col("other").alias("b")))
    final = final.join(members.select("node", _first("of_doc", "of_text").alias("first")), "node")
    heads = final.groupBy("label").agg(F.min("first").alias("head"))
    final = final.join(heads, "label").select(F.col("node").alias("set_id"), "head").join(counts, "set_id", "left")
    # most classes are linked with no other
    per_class = classes.select("set_id", "n_docs", F.col("first").alias("copy_of")).join(final, "set_id", "left")
    per_class = per_class.select("set_id", "copy_of", F.coalesce("head", "copy_of").alias("head"), (F.coalesce("linked", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    # staged, so that AQE can split a large group of copies in the join with all rows
    per_class = stage(per_class, "linked")
    for x in (classes, members, decided):
        unstage(x)
    return marked.select("doc_id", "text_key", "set_id").join(per_class, "set_id", "left")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, class_id, n_links, copy_of for each row.

    class_id: the smallest doc_id that the document is linked with, over any number of links of the given similarity; copy_of:
    the smallest doc_id with an equal set of shingles; n_links: documents (rows) linked directly, copies included. Both are
    null only where all ids of the class are null. Texts without words (null, empty, blank) have no links and are each their
    own class. Fewer than five words are one shingle. Repeated rows are copies. An empty table gives an empty result; other
    columns are not carried.
    """
    found, worded = classified(docs, threshold), F.col("set_id").isNotNull()
    own = lambda c: F.when(worded, F.col(f"{c}.doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_key", own("head").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own("copy_of").alias("copy_of"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one document of each class: the one of the smallest doc_id, or one without id if none has an id. Of repeated rows one stays; texts without words all stay. Columns are unchanged, whatever their names."""
    none, doc, key = at = unused(docs, "_none", "_doc", "_key")
    keys = lambda doc_id, text_key: [doc_id.isNull().alias(none), F.coalesce(doc_id, F.lit(0)).alias(doc), text_key.alias(key)]
    heads = classified(docs).filter("set_id is not null").select(*keys(F.col("head.doc_id"), F.col("head.text_key"))).distinct()
    worded = F.coalesce(F.btrim("text", F.lit(" \t\n\r\x0b\x0c")), F.lit("")) != ""
    rows = docs.filter(worded).select("*", *keys(F.col("doc_id").cast("long"), F.xxhash64("text")))
    # repeated rows go first, by what the join is dealt out by: texts are shuffled once, unless ids aren't whole numbers
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    first = rows.dropDuplicates(at if whole else [*at, "doc_id"]).join(heads, at, "left_semi")
    return first.select(*docs.columns).unionByName(docs.filter(~worded))


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's class and number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
    ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b, i = x.n AND i = y.n AS same FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE i >= 0.8 * (x.n + y.n - i) - 1e-9),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.m FROM r JOIN l ON r.d = l.a)
SELECT d AS doc_id, min(m) AS class_id, coalesce((SELECT count(*) FROM l WHERE a = d), 0) AS n_links,
  least(d, coalesce((SELECT min(b) FROM l WHERE a = d AND same), d)) AS copy_of
FROM r GROUP BY d
"""
