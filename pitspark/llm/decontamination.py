"""Benchmark decontamination by template windows.

Numbers, names and units become typed placeholders, so a question whose values were changed keeps its template. Windows of
template words of the benchmark are hash-joined with those of the documents; a window counts if its literal words suffice and
the values map one to one: the same value of the question always stands for the same value of the document, and the other
way around. Windows whose words are equal are joined as well, whatever share of them are values. A document is contaminated
by an item with which it shares a window of either kind.

A Bloom filter of the benchmark's window hashes, of bounded size whatever the benchmark's, tells which windows of a document
can match at all; only those leave the scan. The join then compares templates, so a false alarm costs a row and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Numbers, chunks, small_batches, stage, table, unused

#: Words of a window; a shorter item is one window of all its words.
WINDOW = 13
#: Literal words that a window of placeholders needs: two, and a quarter of its words.
LITERALS, LITERAL_SHARE = 2, 4
#: The filter's bits a hash, its size (a power of two) at most, 32 MB, and the bits looked up for a hash.
BITS, MOST_BITS, PROBES = 64, 28, 4
# fixed values: words for units
UNITS = frozenset("km kilometers kilometres kilometer kilometre m meters metres meter metre cm centimeters centimetres mm millimeters miles mile feet foot ft inches inch yards yard kg kilograms kilogram g grams gram mg tons tonnes ton lb lbs pounds pound oz ounces ounce l liters litres liter litre ml gallons gallon hours hour minutes minute seconds second days day weeks week months month years year dollars dollar euros euro cents cent percent degrees degree celsius fahrenheit mph kmh kph watts watt kw volts volt".split())
PLAIN_ENDS = frozenset(".,;:!?")
_NUMBER = regex.compile(r"[+\-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th|\p{L}{1,3})?")
_NAME = regex.compile(r"\p{Lu}\p{Ll}+(?:[-'’]\p{L}+)*")
_EDGE = regex.compile(r"^[\p{P}\p{S}--[$€£+\-]]+|[\p{P}\p{S}--[%]]+$", regex.V1)


def canonical(word: str) -> tuple[str, str, bool]:
    """(template word inside a sentence, at its start, whether the sentence ends after it). A slot's word begins with <."""
    plain = word[:-1] if word[-1:] in PLAIN_ENDS else word
    if plain.isascii() and plain.isalpha() and (plain.islower() or len(plain) > 1 and plain[0].isupper() and plain[1:].islower()):  # what the patterns below say of such words
        low, ends = plain.lower(), word[-1] in ".!?:"
        if low in UNITS:
            return "<unit>", "<unit>", ends
        return (low if low == plain else "<name>"), low, ends
    ends = word[-1:] in ".!?:" or word[-2:-1] in (".", "!", "?") and word[-1:] in "\"')”’"
    bare = _EDGE.sub("", word)
    if _NUMBER.fullmatch(bare):
        return "<num>", "<num>", ends
    low = bare.lower()
    if low in UNITS:
        return "<unit>", "<unit>", ends
    low = low.replace("<", "‹")
    return ("<name>" if _NAME.fullmatch(bare) else low), low, ends


def literal(word: str) -> str:
    """The word without punctuation at its edges, in lower case."""
    plain = word[:-1] if word[-1:] in PLAIN_ENDS else word
    return (plain if plain.isascii() and plain.isalpha() else _EDGE.sub("", word)).lower()


class Reader:
    """Template words of texts as hashes; remembers words, within bounds."""

    def __init__(self, most: int = 200_000) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.codes = np.zeros((3, 1024), np.uint64)  # inside a sentence, at its start, the word itself
        self.flags = np.zeros((2, 1024), bool)  # whether the sentence ends after it, whether there is anything but punctuation

    def learn(self) -> None:
        """Look at the new words."""
        inner, start, own, ends = [], [], [], []
        code = xxhash.xxh64_intdigest
        new, self.known.new = self.known.new, []
        for word in new:
            a, b, end = canonical(word)
            start.append(of_start := code(b))
            inner.append(of_start if a == b else code(a))
            own.append(code(literal(word)) if b[:1] == "<" else of_start)  # others stand for themselves
            ends.append((end, b != ""))
        m, n = len(self.known), len(self.known) - len(new)
        if m > self.codes.shape[1]:
            more = max(m, 2 * self.codes.shape[1]) - self.codes.shape[1]
            self.codes = np.pad(self.codes, ((0, 0), (0, more)))
            self.flags = np.pad(self.flags, ((0, 0), (0, more)))
        self.codes[:, n:m] = np.array([inner, start, own], dtype=np.uint64)
        self.codes[2, n:m] ^= np.uint64(_OWN)
        self.flags[:, n:m] = np.array(ends).T

    def read(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of all texts the words that are not punctuation only, whose text each is, whether it begins a sentence, and its hashes: as a template word, as one at a start, and as a word."""
        if len(self.known) > self.most:
            self.forget()
        words: list[str] = []
        lines, after = [], []
        for text in texts:
            for line in text.split("\n"):
                words += line.split()
                lines.append(len(words))
            after.append(len(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn()
        ends, full = self.flags[:, at]
        kept = np.flatnonzero(full)
        # a sentence begins if one ended, or a line did, since the last word that is kept
        before = np.r_[0, np.cumsum(ends)]
        line = np.searchsorted(lines, kept, "right")
        first = np.ones(len(kept), bool)
        first[1:] = (before[kept[1:]] > before[kept[:-1]]) | (line[1:] != line[:-1])
        codes = self.codes[:, at[kept]]
        codes[0, first] = codes[1, first]
        return [words[i] for i in kept.tolist()] if len(kept) < len(words) else words, np.searchsorted(after, kept, "right"), first, codes


_OWN = 0xD6E8FEB86659FD93  # keeps the rows' hashes apart
_R, _R_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Two hashes for each run of width words: of the template words, the first of which counts as a sentence's first, and of the words themselves.

    Polynomial hashes, as differences of running sums.
    """
    n = codes.shape[1]
    if n < width:
        return np.zeros((2, 0), np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros((2, n + 1), np.uint64)
        np.cumsum(codes[::2] * _powers(_R, n), axis=1, out=sums[:, 1:])
        out = (sums[:, width:] - sums[:, :-width]) * _powers(_R_INVERSE, n - width + 1)
        out[0] += codes[1, : n - width + 1] - codes[0, : n - width + 1]
        return (out ^ (out >> np.uint64(29))) * np.uint64(_R)


def _places(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """The bit of each hash that a probe looks up, in a filter of 2 ** bits bits."""
    with np.errstate(over="ignore"):
        return (hashes * np.uint64(2 * probe * 0x632BE59BD9B4E019 + 1 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)


def bloom(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter of the n hashes of a column hash: its words of 64 bits, at most 2 ** MOST_BITS bits."""
    bits = min(MOST_BITS, max(12, (BITS * n).bit_length()))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            h = df["hash"].to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([_places(h, k, bits) for k in range(PROBES)]))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    words = hashes.select("hash").mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).view(np.uint64)
    return out


def sifted(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Indices of the hashes that the filter doesn't rule out."""
    bits = (len(sieve) << 6).bit_length() - 1
    near = np.arange(len(hashes))
    for k in range(PROBES):
        at = _places(hashes[near], k, bits)
        near = near[(sieve[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return near


FIELDS = "pos int, width int, hash long, template string, slots array<string>"


def _windows(reader: Reader, texts: list[str], widths: tuple[int, ...] | None, sieve: np.ndarray | None) -> list[tuple]:
    """(index of the text, pos, width, hash, template, slots) of the windows that can match; widths None: an item's own.

    A window of the words themselves has "=" before them and no slots. Of template words, LITERALS and a share must be literal.
    """
    words, owner, first, codes = reader.read(texts)
    begin = np.searchsorted(owner, np.arange(len(texts)))
    sizes = np.bincount(owner, minlength=len(texts))
    out = []
    for width in widths or np.unique(np.minimum(sizes[sizes > 0], WINDOW)).tolist():
        for row, hashes in enumerate(window_hashes(codes, width)):
            near = np.arange(len(hashes)) if sieve is None else sifted(hashes, sieve)
            near = near[owner[near] == owner[near + width - 1]]
            if not widths:
                near = near[np.minimum(sizes[owner[near]], WINDOW) == width]
            for i in near.tolist():
                here = words[i : i + width]
                if row:
                    template, slots = " ".join(["=", *map(literal, here)]), []
                else:
                    parts = [canonical(w)[1 if k == 0 or first[i + k] else 0] for k, w in enumerate(here)]
                    slots = [f"{t}{_EDGE.sub('', w).lower()}" for t, w in zip(parts, here, strict=True) if t[0] == "<"]
                    if not slots or width - len(slots) < max(LITERALS, -(-width // LITERAL_SHARE)):  # without slots it is the window of the words
                        continue
                    template = " ".join(parts)
                out.append((int(owner[i]), int(i - begin[owner[i]]), width, int(hashes[i].view(np.int64)), template, slots))
    return out


def _table(rows: DataFrame, key: str, widths: tuple[int, ...] | None, sieve: np.ndarray | None) -> DataFrame:
    shared = None if sieve is None else rows.sparkSession.sparkContext.broadcast(sieve)  # at most 2 ** MOST_BITS bits

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader()
        for df in parts:
            keys = df[key].tolist()
            for at, texts in chunks(df["text"].tolist()):
                out = [(keys[at + k], *w) for k, *w in _windows(reader, texts, widths, None if shared is None else shared.value)]
                yield pd.DataFrame(out, columns=[key, "pos", "width", "hash", "template", "slots"])

    return rows.select(F.col(key).cast("long").alias(key), "text").mapInPandas(run, f"{key} long, {FIELDS}")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, verbatim, first_pos): a row for each document and item that share consistent windows.

    n_windows: places of the document's windows; verbatim: some window has equal values as well. Null and empty texts
    match nothing. An item under WINDOW words is one window; it needs LITERALS literal words to match with other values, and
    none to match as it stands. Repeated rows count once. Empty tables give an empty result; other columns are not carried.
    """
    small_batches(docs.sparkSession)
    # written as it comes: dealt out first, a few items would make a file for each shuffle partition
    items = stage(_table(benchmark, "item_id", None, None), "items")
    n, widths = items.agg(F.count("*"), F.collect_set("width")).first()  # WINDOW widths at most
    sieve = bloom(items, n)
    theirs = items.select("item_id", "width", "hash", "template", F.col("pos").alias("item_pos"), F.col("slots").alias("of_item")).distinct()
    pairs = _table(docs, "doc_id", tuple(widths) or (WINDOW,), sieve).join(theirs, ["hash", "width", "template"])
    pairs = pairs.withColumn("values", F.arrays_zip("slots", "of_item")).withColumn("same", F.col("slots") == F.col("of_item"))

    def one_to_one(values):
        sides = [F.array_distinct(F.transform(values, lambda v: v["slots"])), F.array_distinct(F.transform(values, lambda v: v["of_item"]))]
        return (F.size(F.array_distinct(values)) == F.size(sides[0])) & (F.size(sides[0]) == F.size(sides[1]))

    # windows that lie alike in document and item are one passage, whose values must agree throughout
    passage = pairs.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set("pos").alias("at"), F.collect_set(F.when(F.col("same"), F.col("pos"))).alias("same_at"), F.flatten(F.collect_set("values")).alias("values"))
    # values that changed inconsistently clear all but the verbatim windows
    passage = passage.select("doc_id", "item_id", F.when(one_to_one(F.col("values")), F.col("at")).otherwise(F.col("same_at")).alias("at"), (F.size("same_at") > 0).alias("same"))
    found = passage.select("doc_id", "item_id", "same", F.explode("at").alias("pos"))
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("pos").alias("n_windows"), F.max("same").alias("verbatim"), F.min("pos").alias("first_pos"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents; columns unchanged, whatever their names. Rows are told apart by doc_id and text, so one with a null id, or the id of another, is judged alone."""
    key, bad = unused(docs, "_row", "_bad")
    row = F.xxhash64("doc_id", "text")
    found = contaminated(docs.select(row.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(bad)).distinct()
    return docs.withColumn(key, row).join(found, F.col(key) == F.col(bad), "left_anti").select(*docs.columns)


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, whole or re-parameterised."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_EDGES = (r"^[^\p{L}\p{M}\p{N}\p{Z}\p{C}$€£+\-]+", r"[^\p{L}\p{M}\p{N}\p{Z}\p{C}%]+$")
_SQL_NUMBER = r"[+\-]?[$€£]?\d[\d.,:/]*(%|st|nd|rd|th|\p{L}{1,3})?"
_SQL_NAME = r"\p{Lu}\p{Ll}+([-''’]\p{L}+)*"
OP8_SQL = f"""
WITH src AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
ln AS (SELECT side, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM src WHERE text IS NOT NULL),
wd AS (SELECT side, id, l, unnest(x) AS w, generate_subscripts(x, 1) AS k FROM (SELECT *, list_filter(string_split_regex(line, '\\s+'), lambda y: y <> '') AS x FROM ln)),
sp AS (
  SELECT *, CASE WHEN w[-1] IN ('.', ',', ';', ':', '!', '?') THEN w[:-2] ELSE w END AS plain,
    regexp_replace(regexp_replace(w, '{_SQL_EDGES[0]}', ''), '{_SQL_EDGES[1]}', '') AS bare FROM wd),
cn AS (
  SELECT *, regexp_full_match(plain, '[a-z]+|[A-Z][a-z]+') AS easy,
    CASE WHEN regexp_full_match(plain, '[a-z]+|[A-Z][a-z]+') THEN w[-1] IN ('.', '!', '?', ':')
      ELSE w[-1] IN ('.', '!', '?', ':') OR (w[-2:-2] IN ('.', '!', '?') AND w[-1] IN ('"', '''', ')', '”', '’')) END AS ends,
    lower(CASE WHEN regexp_full_match(plain, '[A-Za-z]+') THEN plain ELSE bare END) AS lit FROM sp),
tk AS (
  SELECT side, id, l, k, w, ends, lit, lower(bare) AS val, CASE WHEN easy THEN lower(plain) ELSE replace(lower(bare), '<', '‹') END AS low,
    NOT easy AND regexp_full_match(bare, '{_SQL_NUMBER}') AS num, lower(CASE WHEN easy THEN plain ELSE bare END) IN ({", ".join(f"'{u}'" for u in sorted(UNITS))}) AS unit,
    CASE WHEN easy THEN plain <> lower(plain) ELSE regexp_full_match(bare, '{_SQL_NAME}') END AS name FROM cn),
tt AS (
  SELECT side, id, l, k, ends, lit, val, CASE WHEN num THEN '<num>' WHEN unit THEN '<unit>' ELSE low END AS st, CASE WHEN num THEN '<num>' WHEN unit THEN '<unit>' WHEN name THEN '<name>' ELSE low END AS inn,
    coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY side, id ORDER BY l, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM tk),
kp AS (SELECT *, coalesce(lag(l) OVER q <> l OR lag(c) OVER q < c, true) AS first FROM tt WHERE st <> '' WINDOW q AS (PARTITION BY side, id ORDER BY l, k)),
ct AS (SELECT id, least({WINDOW}, count(*)) AS width FROM kp WHERE side = 1 GROUP BY 1),
kw AS (SELECT kp.*, width FROM kp, (SELECT DISTINCT width FROM ct) WHERE side = 0 UNION ALL SELECT kp.*, width FROM kp JOIN ct USING (id) WHERE side = 1),
wn AS (
  SELECT side, id, width, row_number() OVER q - 1 AS pos, count(*) OVER f AS n, '= ' || string_agg(lit, ' ') OVER f AS lits, st || coalesce(' ' || string_agg(tm, ' ') OVER g, '') AS shape,
    list_concat(CASE WHEN st[1] = '<' THEN [st || val] ELSE CAST([] AS VARCHAR[]) END, coalesce(list(tm || val) FILTER (tm[1] = '<') OVER g, CAST([] AS VARCHAR[]))) AS slots
  FROM (SELECT *, CASE WHEN first THEN st ELSE inn END AS tm FROM kw)
  WINDOW q AS (PARTITION BY side, id, width ORDER BY l, k), f AS (PARTITION BY side, id, width ORDER BY l, k ROWS BETWEEN CURRENT ROW AND width - 1 FOLLOWING),
    g AS (PARTITION BY side, id, width ORDER BY l, k ROWS BETWEEN 1 FOLLOWING AND width - 1 FOLLOWING)),
al AS (
  SELECT side, id, pos, width, lits AS template, CAST([] AS VARCHAR[]) AS slots FROM wn WHERE n = width
  UNION ALL SELECT side, id, pos, width, shape, slots FROM wn
  WHERE n = width AND len(slots) > 0 AND width - len(slots) >= greatest({LITERALS}, (width + {LITERAL_SHARE - 1}) // {LITERAL_SHARE})),
pr AS (SELECT d.id AS doc_id, b.id AS item_id, d.pos, d.pos - b.pos AS shift, d.slots, b.slots AS theirs, d.slots = b.slots AS same FROM al d JOIN al b USING (width, template) WHERE d.side = 0 AND b.side = 1),
vl AS (SELECT doc_id, item_id, shift, unnest(slots) AS a, unnest(theirs) AS b FROM pr),
ok AS (SELECT doc_id, item_id, shift, count(DISTINCT (a, b)) = count(DISTINCT a) AND count(DISTINCT a) = count(DISTINCT b) AS fine FROM vl GROUP BY ALL),
sm AS (SELECT doc_id, item_id, shift, bool_or(same) AS any_same FROM pr GROUP BY ALL)
SELECT doc_id, item_id, count(DISTINCT pos) AS n_windows, bool_or(any_same) AS verbatim, CAST(min(pos) AS INTEGER) AS first_pos
FROM pr LEFT JOIN ok USING (doc_id, item_id, shift) JOIN sm USING (doc_id, item_id, shift) WHERE same OR coalesce(fine, true) GROUP BY 1, 2
"""
