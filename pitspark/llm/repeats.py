"""Removal of repeated byte strings across documents.

Every 100-byte window chooses an anchor: its 24-byte string of the lowest hash. Equal windows choose equal anchors, so windows
can only be equal within an anchor's group, and a document falls into stretches of windows of one anchor. One shuffle brings
an anchor's stretches together. Equal stretches need no further look: all but the first are repeats. Stretches of one anchor
count as equal if 96 bits of independent hashes of all their bytes agree, as their bytes would make the shuffle several times
the input. Where an anchor has different stretches, the first of each goes to a shard. There it is cut to the windows whose
bytes around the anchor another stretch has as well; a suffix array by induced sorting and its permuted common prefixes find
the equal ones among them, byte by byte. Anchors with very many different stretches are split by the windows' next anchors,
again and again until no group is large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage, table
from .suffix import permuted_common_prefixes, suffix_array

WINDOW, GRAM = 100, 24
_SPAN = WINDOW - GRAM + 1
#: Bytes handled at once, places of a chunk fit the key's low bits; bytes of a shard; different stretches of a group before it is split.
_CHUNK, _PLACE_BITS = 1 << 20, 22
#: Windows whose anchors are sought at once: their arrays stay in the CPU's cache.
_BLOCK = 1 << 16
#: Classes of windows, by the bytes before their anchor, that are looked at together before the suffix array.
_CLASSES = 4
SHARD_BYTES, SPLIT = 1 << 20, 1000
_rng = np.random.default_rng(7)
#: Two independent polynomial hashes: a number for each byte, and the base.
_BYTE = _rng.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    with np.errstate(over="ignore"):
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
    return out[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _powers_of(which: int, inverse: bool, n: int) -> np.ndarray:
    found = _powers.get((which, inverse))
    if found is None or len(found) < n:
        base = pow(_BASE[which], -1, 2**64) if inverse else _BASE[which]
        found = _powers[which, inverse] = _power(base, 2 * n)
    return found[:n]


def _sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix sums of a polynomial hash; see _hashes."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[which][data] * _powers_of(which, False, len(data)))])


def _hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of the bytes [start, end)."""
    with np.errstate(over="ignore"):
        return _mix((sums[end] - sums[start]) * _powers_of(which, True, len(sums))[start] + (end - start).astype(np.uint64))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width neighbours."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    return np.minimum(keys[: len(keys) - (width - size)], keys[width - size :]) if size < width else keys


def anchors(data: np.ndarray, owner: np.ndarray, banned: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Stretches of windows that share owner and anchor: first window, window after the last, anchor's hash, two hashes of all bytes, anchor's place.

    owner: whose each byte is; windows lie within one owner. banned: places that can't be anchors.
    """
    n, lo, out = len(data) - WINDOW + 1, 0, []
    while lo < n:
        hi = min(lo + _BLOCK, n)
        end = hi + WINDOW - 1
        here = None if banned is None else banned[(banned >= lo) & (banned <= end - GRAM)] - lo
        *found, rest = _anchors_of_block(data[lo:end], owner[lo:end], here, hi == n)
        out.append((found[0] + lo, found[1] + lo, *found[2:-1], found[-1] + lo))
        lo += rest
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchors_of_block(data: np.ndarray, owner: np.ndarray, banned: np.ndarray | None, last: bool) -> tuple:
    """The anchors of a block, and the first window that is left: the block's end may cut its last stretch, at most _SPAN windows, so that is left unless it's the last block."""
    sums = _sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = _hashes(sums, at, at + GRAM)
    key = (gram >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    if banned is not None:
        key[banned] = (np.uint64(2**64 - 1) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | banned.astype(np.uint64)
    place = (_lowest(key, _SPAN) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = owner[: len(place)] == owner[WINDOW - 1 :]
    change = np.r_[True, (place[1:] != place[:-1]) | (owner[1 : len(place)] != owner[: len(place) - 1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    after = np.r_[first[1:], len(place)]
    rest = len(place)
    if not last:
        rest = int(first[-1])
        first, after = first[:-1], after[:-1]
    first, after = first[valid[first]], after[valid[first]]
    more = (_hashes(_sums(data, 1), first, after + WINDOW - 1, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return first, after, gram[place[first]].view(np.int64), _hashes(sums, first, after + WINDOW - 1).view(np.int64), more, place[first], rest


def _chunks(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, offset, bytes) in lists of about _CHUNK bytes; longer texts go in overlapping parts, each window in one of them."""
    batch, size = [], 0
    for row, text in enumerate(texts):
        if text is None or len(text) < WINDOW:
            continue
        for offset in range(0, len(text) - WINDOW + 1, _CHUNK):
            part = text[offset : offset + _CHUNK + WINDOW - 1]
            batch.append((row, offset, part))
            size += len(part)
            if size >= _CHUNK:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def stretches(docs: DataFrame) -> DataFrame:
    """(known, anchor, content, more, doc_id, tie, start, n): a row for each stretch of each document of (doc_id, tie, data).

    known: an equal stretch that starts earlier was met in the same chunk, so this one needs no comparison.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            ids, ties = df["doc_id"].to_numpy(), df["tie"].to_numpy()
            for batch in _chunks(df["data"].tolist()):
                sizes = [len(b) for _, _, b in batch]
                owner = np.repeat(np.arange(len(batch)), sizes)
                first, after, anchor, content, more, _ = anchors(np.frombuffer(b"".join(b for _, _, b in batch), np.uint8), owner)
                of = owner[first]
                row = np.array([r for r, _, _ in batch])[of]
                start = first - (np.cumsum(sizes) - sizes)[of] + np.array([o for _, o, _ in batch])[of]
                order = np.lexsort((start, ties[row], ids[row], more, content, anchor))
                out = pd.DataFrame({"anchor": anchor, "content": content, "more": more, "doc_id": ids[row], "tie": ties[row], "start": start, "n": (after - first + WINDOW - 1)}).iloc[order]
                kind = out[["anchor", "content", "more"]].to_numpy()
                new = np.r_[True, (kind[1:] != kind[:-1]).any(1)] if len(out) else np.zeros(0, bool)
                head = np.maximum.accumulate(np.where(new, np.arange(len(out)), 0))
                place = out[["doc_id", "tie", "start"]].to_numpy()
                at_head = (place == place[head]).all(1)  # the head itself, or a repeated row of its document
                out.insert(0, "known", ~at_head)
                yield out[new | ~at_head]

    return docs.mapInPandas(run, "known boolean, anchor long, content long, more int, doc_id long, tie int, start int, n int")


def compare(found: DataFrame) -> DataFrame:
    """(again, anchor, doc_id, tie, start, n): stretches equal to an earlier one (again), and the first of each kind where the anchor has several.

    Rows stream in order, so memory is bounded whatever an anchor's number of stretches.
    """
    names = ["again", "anchor", "doc_id", "tie", "start", "n"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = pending = None  # the row before; the anchor's first stretch, while it is the only kind
        for df in parts:
            if df["known"].any():
                yield df[df["known"]].assign(again=True)[names]
                df = df[~df["known"]]
            df = df.drop(columns="known")
            if not len(df):
                continue
            rows = df if last is None else pd.concat([last, df], ignore_index=True)
            a, c, d = (rows[k].to_numpy() for k in ("anchor", "content", "more"))
            new_a = np.r_[last is None, a[1:] != a[:-1]]
            new_c = new_a | np.r_[last is None, (c[1:] != c[:-1]) | (d[1:] != d[:-1])]
            same = np.r_[False, np.logical_and.reduce([rows[k].to_numpy()[1:] == rows[k].to_numpy()[:-1] for k in ("doc_id", "tie", "start")])]
            fresh = np.ones(len(rows), bool)
            fresh[0] = last is None  # the row before was handled
            again = rows[fresh & ~new_c & ~same]
            firsts, is_new = rows[fresh & new_c], new_a[fresh & new_c]
            if pending is not None and len(firsts):
                firsts, is_new = pd.concat([pending, firsts], ignore_index=True), np.r_[True, is_new]
                pending = None
            if len(firsts):
                more = np.r_[~is_new[1:], False]  # another kind of the same anchor follows
                if is_new[-1]:
                    pending = firsts.iloc[-1:]
                firsts = firsts[~is_new | more]
            last = rows.iloc[-1:]
            yield pd.concat([again.assign(again=True), firsts.assign(again=False)])[names]

    order = ["anchor", "content", "more", "doc_id", "tie", "start"]
    # what is known needs no company, so it is dealt out evenly
    found = found.repartition("anchor", F.when(F.col("known"), F.xxhash64("doc_id", "start")).otherwise(F.lit(0)))
    return found.sortWithinPartitions(*order).mapInPandas(run, "again boolean, anchor long, doc_id long, tie int, start int, n int")


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indices of runs of neighbouring starts of one document."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero((doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))
    return np.r_[0, edge + 1], np.r_[edge, len(doc) - 1]


def comparable(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indices, begins, ends) of the parts of stretches that have windows which may equal one of another part, cut to these.

    A stretch's windows share their anchor: of the strings in all of them the lowest one. Equal windows have it at the same
    place, so no two of one part are equal, and windows of different parts with about as many bytes before the anchor hold
    the same bytes around it. Windows are left out where no other part has those. Hashes that agree by chance only keep more.
    """
    sizes = np.array([len(p) for p in parts])
    begin = np.cumsum(sizes) - sizes
    end = begin + sizes
    sums = _sums(np.frombuffer(b"".join(parts), np.uint8))
    many = 2 * WINDOW - sizes - GRAM + 1
    head = np.cumsum(many) - many
    at = np.arange(int(many.sum())) - np.repeat(head - (end - WINDOW), many)
    key = (_hashes(sums, at, at + GRAM) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | (at - np.repeat(begin, many)).astype(np.uint64)
    anchor = begin + (np.minimum.reduceat(key, head) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    lo, hi = end.copy(), begin.copy()
    edges = np.arange(_CLASSES + 1) * _SPAN // _CLASSES
    for least, most in zip(edges[:-1], edges[1:] - 1, strict=True):
        a, z = np.maximum(begin, anchor - most), np.minimum(end - WINDOW, anchor - least)  # the class's first and last window
        own = np.flatnonzero(a <= z)
        _, kind, count = np.unique(_hashes(sums, anchor[own] - least, anchor[own] - most + WINDOW), return_inverse=True, return_counts=True)
        own = own[count[kind] > 1]
        lo[own], hi[own] = np.minimum(lo[own], a[own]), np.maximum(hi[own], z[own] + WINDOW)
    kept = np.flatnonzero(lo < hi)
    return kept, (lo - begin)[kept], (hi - begin)[kept]


def repeated_in_shard(parts: list[bytes], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """(doc_id, tie, first, after): bytes of the stretches that lie in windows found earlier in the shard."""
    sizes = np.array([len(p) for p in parts])
    gap = np.concatenate([np.frombuffer(p + b"\0", np.uint8) for p in parts])
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    begin = np.cumsum(sizes + 1) - sizes - 1
    inside = np.arange(len(gap)) - begin[owner]
    codes = gap.astype(np.int64) + 2
    codes[inside == sizes[owner]] = 1
    order = suffix_array(codes)
    common = permuted_common_prefixes(gap, order, WINDOW)
    # a shared 100 bytes must not run over a separator
    whole = inside + WINDOW <= sizes[owner]
    group = np.cumsum(~((common >= WINDOW) & whole)[order] | ~whole[np.r_[order[:1], order[:-1]]])
    at = order[whole[order]]
    group = group[whole[order]]
    docs = np.lexsort((tie, doc))
    rank = np.empty(len(parts), np.int64)
    new = np.r_[True, (doc[docs][1:] != doc[docs][:-1]) | (tie[docs][1:] != tie[docs][:-1])]
    rank[docs] = np.cumsum(new)
    where = (rank[owner[at]] << 32) + start[owner[at]] + inside[at]
    lowest = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max)
    np.minimum.at(lowest, group, where)
    later = np.sort(np.unique(where[where > lowest[group]]))
    a, b = _runs(later >> 32, later & 0xFFFFFFFF)
    back = docs[np.flatnonzero(new)]  # a stretch of the document of each rank
    of = back[(later[a] >> 32) - 1]
    return pd.DataFrame({"doc_id": doc[of], "tie": tie[of], "first": (later[a] & 0xFFFFFFFF).astype(np.int32), "after": ((later[b] & 0xFFFFFFFF) + WINDOW).astype(np.int32)})


def _split(parts: list[tuple], have: int, want: int) -> list[tuple]:
    """(key, doc_id, tie, start, bytes) of the parts of such stretches, whose windows share `have` anchors, by the next anchors up to `want` of them."""
    taken = np.zeros((len(parts), 0), np.int64)  # places of the anchors so far, from each part's start
    for level in range(want):
        data = np.frombuffer(b"".join(x[4] for x in parts), np.uint8)
        sizes = np.array([len(x[4]) for x in parts])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)
        banned = (taken + begin[:, None]).ravel()
        first, after, anchor, _, _, place = anchors(data, owner, banned)
        of = owner[first]
        if level < have:  # one stretch each
            taken = np.column_stack([taken, place - begin])
            continue
        with np.errstate(over="ignore"):
            keys = _mix(anchor.view(np.uint64) + np.array([x[0] for x in parts], np.int64).view(np.uint64)[of] * np.uint64(_BASE[0])).view(np.int64)
        shift = first - begin[of]
        taken = np.column_stack([taken[of] - shift[:, None], place - first])
        old = parts
        parts = [(key, *old[o][1:3], old[o][3] + i, old[o][4][i : i + n]) for key, o, i, n in zip(keys.tolist(), of.tolist(), shift.tolist(), (after - first + WINDOW - 1).tolist(), strict=True)]
    return parts


def _in_batches(parts: Iterator[tuple], have: int, want: int) -> Iterator[pd.DataFrame]:
    """Frames of the parts, split; as many at once as make a chunk."""
    batch, size = [], 0
    for x in parts:
        batch.append(x)
        size += len(x[4])
        if size >= _CHUNK:
            yield pd.DataFrame(_split(batch, have, want) if want > have else batch, columns=_COLUMNS)
            batch, size = [], 0
    if batch:
        yield pd.DataFrame(_split(batch, have, want) if want > have else batch, columns=_COLUMNS)


_COLUMNS = ["key", "doc_id", "tie", "start", "part"]
PIECES = "key long, doc_id long, tie int, start int, part binary"


def _cut(docs: DataFrame, kinds: DataFrame, want: int) -> DataFrame:
    """The bytes of stretches, by their anchor, or split by `want` anchors; kinds: (anchor, doc_id, tie, start, n)."""
    per_doc = kinds.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("anchor", "start", "n")).alias("kinds"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (x for df in frames for x in zip(df["doc_id"], df["tie"], df["data"], df["kinds"], strict=True))
        cut = ((x["anchor"], doc, tie, x["start"], data[x["start"] : x["start"] + x["n"]]) for doc, tie, data, kinds in rows for x in kinds)
        yield from _in_batches(cut, 1, want)

    return docs.join(per_doc, ["doc_id", "tie"]).select("doc_id", "tie", "data", "kinds").mapInPandas(run, PIECES)


def _split_more(pieces: DataFrame, have: int, want: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _in_batches((x for df in frames for x in df.itertuples(index=False, name=None)), have, want)

    return pieces.select(*_COLUMNS).mapInPandas(run, PIECES)


def settled(docs: DataFrame, kinds: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups of very many stretches in parts that share so many anchors that their groups are small: (pieces, spans of equal parts but the first).

    Each round doubles the anchors and looks at what is still in large groups alone. Windows have _SPAN anchors to choose
    from, and windows that agree on all of them are equal, so the rounds end.
    """
    have, want = 1, 2
    parts = stage(_cut(docs, kinds, want), "parts")
    pieces, again = [], []
    while True:
        # equal parts need no suffix array; Spark sums them up before the shuffle, so copies don't gather
        place = F.struct("doc_id", "tie", "start")
        firsts = stage(parts.groupBy("key", "part").agg(F.min(place).alias("first")), "firsts")
        later = parts.join(firsts, ["key", "part"]).filter(place > F.col("first"))
        again.append(later.select("doc_id", "tie", F.col("start").alias("first"), (F.col("start") + F.octet_length("part")).alias("after")))
        left = firsts.select("key", "first.doc_id", "first.tie", "first.start", "part")
        hot = stage(left.groupBy("key").agg(F.count("*").alias("k")).filter(F.col("k") > SPLIT).select("key"), "hot")
        have, want = want, min(2 * want, _SPAN)
        if have == want or hot.isEmpty():
            return [*pieces, left], again
        pieces.append(left.join(hot, "key", "left_anti"))
        parts = stage(_split_more(left.join(hot, "key", "left_semi"), have, want), "parts")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, first, after): stretches of bytes to remove, which may overlap; docs: (doc_id, tie, data)."""
    # gathered, as a stretch takes few bytes: else each task that compares them makes a file, and local file systems start programs for each
    found = stage(compare(stretches(docs)).hint("rebalance", F.col("doc_id")), "stretches")
    again = found.filter("again").select("doc_id", "tie", F.col("start").alias("first"), (F.col("start") + F.col("n")).alias("after"))
    kinds = found.filter("not again").drop("again")
    # written, so the planner knows its size: a row for each group of over SPLIT
    hot = stage(kinds.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > SPLIT).select("anchor"), "hot")
    pieces = _cut(docs, kinds.join(hot, "anchor", "left_anti"), 1)
    more, equal = ([], []) if hot.isEmpty() else settled(docs, kinds.join(hot, "anchor", "left_semi"))
    size = (kinds.agg(F.sum("n")).first()[0] or 0) + sum(x.agg(F.sum(F.octet_length("part"))).first()[0] or 0 for x in more)
    shards = max(1, -(-size // SHARD_BYTES))
    for x in more:
        pieces = pieces.unionByName(x)
    for x in equal:
        again = again.unionByName(x)
    # a document that repeats as a row gives its stretches twice; they are the same places

    def sort_shard(df: pd.DataFrame) -> pd.DataFrame:
        parts = df["part"].tolist()
        at, begin, end = comparable(parts)
        if not len(at):
            return pd.DataFrame(columns=["doc_id", "tie", "first", "after"])
        parts = [parts[k][a:z] for k, a, z in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True)]
        return repeated_in_shard(parts, df["doc_id"].to_numpy()[at], df["tie"].to_numpy()[at], df["start"].to_numpy().astype(np.int64)[at] + begin)

    inner = pieces.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(sort_shard, "doc_id long, tie int, first int, after int")
    return again.unionByName(inner)


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) and kept_sha256 for each row; other columns are not carried.

    A byte goes if some 100-byte string over it also starts earlier: in a smaller doc_id, or before in the same document.
    Null counts as empty; texts under 100 bytes stay. A null id comes after all others. Rows of equal id and text are one
    document and get the same result; rows of equal id and different texts come in the order of the texts' hashes. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    last = F.lit(2**63 - 1)  # stands for a null id
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    twice = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    rows = rows.withColumn("tie", F.hash("data") if twice else F.lit(0))
    spans = repeated_spans(rows).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("first", "after")).alias("spans"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            out = []
            for doc, data, spans in zip(df["doc_id"], df["data"], df["spans"], strict=True):
                merged: list[list[int]] = []
                for x in sorted((x["first"], x["after"]) for x in spans) if spans is not None else ():
                    if merged and x[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x[1])
                    else:
                        merged.append(list(x))
                edges = [0, *(y for x in merged for y in x), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(merged), kept, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return rows.join(spans, ["doc_id", "tie"], "left").select("doc_id", "data", "spans").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string").withColumn("doc_id", F.nullif("doc_id", last))


def op10_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without their repeated 100-byte strings; rows are gathered from the tasks that had the texts, so the result comes in few files."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept").hint("rebalance", F.col("doc_id"))


OP10_SQL = """
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, b, unnest(range(0, n - 99)) AS p FROM t WHERE n >= 100),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, b[p + 1 : p + 100] AS x FROM w) QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1),
m AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 100 AS new FROM r),
i AS (SELECT doc_id, p, sum(CAST(new AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM m),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY 1, 2),
e AS (SELECT doc_id, k, coalesce(lag(z) OVER q, 0) AS a, a AS z FROM s WINDOW q AS (PARTITION BY doc_id ORDER BY k) UNION ALL SELECT doc_id, 1000000000, max(s.z), max(n) FROM s JOIN t USING (doc_id) GROUP BY 1),
p AS (SELECT doc_id, string_agg(hex(b[a + 1 : z]), '' ORDER BY k) AS kept FROM e JOIN t USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN spans > 0 THEN unhex(kept) ELSE b END) AS kept_sha256
FROM t LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)
"""
