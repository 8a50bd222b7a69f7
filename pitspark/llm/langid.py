"""Language identification: word log frequencies first, shorter and shorter character n-grams for unseen words.

A word seen in training adds its log frequency in each language to the text's score. An unseen word adds the mean over its
n-grams of the greatest length of which any is known. Frequencies are kept sparsely: what a language has not seen costs
nothing, so the model grows with the sample and not with the number of languages times words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Numbers, chunks, small_batches, stage, table

#: Bounds of the labelled sample: different texts a language, and in all; each language has one at least. Longest n-gram.
MAX_DOCS, MAX_TOTAL, MAX_GRAM = 500, 20_000, 5
#: Words whose scores are remembered, and scores held at once.
_REMEMBERED, _SCORES = 200_000, 2_000_000
_LETTERS = regex.compile(r"\p{L}+")


def _marked(word: str) -> str:
    return f"<{word}>"


@dataclass
class Counts:
    """Times of each key in each language, sparsely: key number -> [begin[n], begin[n + 1]) in langs and logs."""

    number: dict[str, int]
    begin: np.ndarray
    langs: np.ndarray
    logs: np.ndarray  # log frequency above that of an unseen key
    floor: np.ndarray  # log frequency of an unseen key in each language

    @classmethod
    def of(cls, keys: list[str], langs: np.ndarray, times: np.ndarray, n_langs: int) -> Counts:
        """With add-half smoothing; keys may repeat."""
        number = Numbers()
        rows = np.fromiter(map(number.__getitem__, keys), np.int64, len(keys))
        pair, inverse = np.unique(rows * n_langs + langs, return_inverse=True)
        n = np.bincount(inverse, times, len(pair))
        rows, langs = pair // n_langs, pair % n_langs
        total = np.bincount(langs, n, n_langs)
        floor = np.log(0.5 / (total + 0.5 * max(1, len(number))))
        return cls(dict(number), np.searchsorted(rows, np.arange(len(number) + 1)), langs, np.log(2 * n + 1), floor)

    def look(self, key: str) -> tuple[np.ndarray, np.ndarray] | None:
        at = self.number.get(key)
        if at is None:
            return None
        a, b = self.begin[at], self.begin[at + 1]
        return self.langs[a:b], self.logs[a:b]


@dataclass
class LanguageModel:
    langs: list[str]
    tables: list[Counts]  # words, then n-grams of length 1 and up

    def word(self, w: str) -> tuple[int, np.ndarray, np.ndarray]:
        """(table, languages, log frequencies above the table's floor) of a lower-case word; table -1: no evidence."""
        found = self.tables[0].look(w)
        if found is not None:
            return 0, *found
        marked = _marked(w)
        for size in range(MAX_GRAM, 0, -1):
            grams = [g for g in (self.tables[size].look(marked[i : i + size]) for i in range(len(marked) - size + 1)) if g is not None]
            if grams:
                return size, np.concatenate([g[0] for g in grams]), np.concatenate([g[1] for g in grams]) / len(grams)
        return -1, np.zeros(0, np.int64), np.zeros(0)


class Predictor:
    """Scores texts by a model; remembers words, within bounds."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.n = model, len(model.langs)
        self.floors = np.array([*[t.floor for t in model.tables], np.zeros(self.n)])  # the last one: no evidence
        self.most = max(1, _SCORES // max(1, self.n))
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.table, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.langs, self.logs = np.zeros(0, np.int64), np.zeros(0)

    def learn(self) -> None:
        """Look up the new words."""
        new, self.known.new = self.known.new, []
        found = [self.model.word(w) for w in new]
        self.table = np.concatenate([self.table, np.array([t for t, _, _ in found]) % len(self.floors)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for _, x, _ in found])])
        self.langs = np.concatenate([self.langs, *[x for _, x, _ in found]])
        self.logs = np.concatenate([self.logs, *[x for _, _, x in found]])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability of each text; und and 0 if it is null or has no letter. Of equal scores the first language by name wins."""
        if not self.n:
            return [("und", 0.0)] * len(texts)
        return [x for _, part in chunks(texts, most=self.most) for x in self._predict(part)]

    def _predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if len(self.known) > _REMEMBERED:
            self.forget()
        words: list[str] = []
        after = []
        for text in texts:
            words += _LETTERS.findall(text.lower())
            after.append(len(words))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self.learn()
        sizes = np.diff(after, prepend=0)
        owner = np.repeat(np.arange(len(texts)), sizes)
        kinds, n = len(self.floors), self.n
        total = np.bincount(owner * kinds + self.table[at], minlength=len(texts) * kinds).reshape(-1, kinds) @ self.floors
        # each word's own languages, one after another
        count = self.begin[at + 1] - self.begin[at]
        place = np.arange(int(count.sum())) + np.repeat(self.begin[at] - np.cumsum(count) + count, count)
        total += np.bincount(np.repeat(owner, count) * n + self.langs[place], self.logs[place], len(texts) * n).reshape(-1, n)
        best = total.argmax(1)
        score = 1 / np.exp(np.minimum(total - total[np.arange(len(texts)), best][:, None], 0)).sum(1)
        return [(self.model.langs[b], float(s)) if m else ("und", 0.0) for b, s, m in zip(best.tolist(), score, sizes.tolist(), strict=True)]


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_total: int = MAX_TOTAL) -> LanguageModel:
    """Fit on a bounded sample of labelled texts, chosen by their hashes, each taken whole and once.

    A language has about max_docs texts, or its even share of max_total where there are many languages, and one at least.
    Words are counted by Spark; the driver gets those of the sample, all of them. Rows with null text or language don't count.
    """
    rows = docs.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    langs = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least"))
    quota = F.least(F.lit(max_docs), F.greatest(F.lit(1), F.floor(F.lit(max_total) / F.count("*").over(Window.partitionBy(F.lit(0))))))
    # the hash as a number from 0 to 1 is under the share, or is the language's first; a row a language, written so that the planner knows its size
    shares = langs.select(F.col("lang").alias("of"), "least", (quota / F.greatest(F.col("n"), F.lit(1))).alias("share"))
    shares = stage(shares, "shares")
    chosen = rows.join(shares, F.col("lang") == F.col("of")).filter((F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)) | (F.col("h") == F.col("least")))
    sample = chosen.groupBy("lang", "h").agg(F.first("text").alias("text"))
    token = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), 1)).alias("w")
    counts = sample.select("lang", token).groupBy("lang", "w").agg(F.count("*").alias("n")).toPandas()
    return build(counts["lang"].tolist(), counts["w"].tolist(), counts["n"].to_numpy(np.int64))


def build(langs: list[str], words: list[str], times: np.ndarray) -> LanguageModel:
    """The model of (language, word, times) rows."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel([], [])
    number = {x: i for i, x in enumerate(names)}
    of = np.array([number[x] for x in langs], dtype=np.int64)
    tables = [Counts.of(words, of, times, len(names))]
    marked = [_marked(w) for w in words]
    for size in range(1, MAX_GRAM + 1):
        n = np.array([max(0, len(m) - size + 1) for m in marked], dtype=np.int64)
        grams = [m[j : j + size] for m in marked for j in range(len(m) - size + 1)]
        tables.append(Counts.of(grams, np.repeat(of, n), np.repeat(times, n), len(names)))
    return LanguageModel(names, tables)


def predict_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row, from its whole text alone.

    Null texts and texts without a letter give und and 0; repeated rows give repeated results; other columns are not
    carried, so their names don't matter; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded sample

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Predictor(shared.value)
        for df in parts:
            out = own.predict(df["text"].tolist())
            yield pd.DataFrame({"doc_id": df["doc_id"], "lang_pred": [a for a, _ in out], "score": [b for _, b in out]})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from documents that are not held out. One without a doc_id counts as held out."""
    docs = table(spark, sf_dir, "documents")
    held = lambda: F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    model = train(docs.filter(~held()))
    return predict_language(docs, model).select("doc_id", held().alias("held_out"), "lang_pred", "score")
