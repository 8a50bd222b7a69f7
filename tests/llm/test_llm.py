"""The training-data operators against plain versions, on small tables with nulls, empties, ties, repeats and foreign columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import chat, common, decontamination, html_extraction, jaccard, langid, line_dedup, packing, quality, queries, repeats, sharding, suffix

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, block string"


def make(spark, texts, lang="en"):
    return spark.createDataFrame([(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], lang, f"s{i % 4}", 0, 9, "x") for i, t in enumerate(texts)], DOCS)


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


A, B = prose(80, 1), prose(80, 2)
ODD = [None, "", " \n\t ", A, A, A.replace(A.split()[40], "changed"), B, "x" * 5000, (3, A), (3, "other text under the same id"), "ñ" * 300]
CASES = {"odd": ODD, "none": []}


@pytest.fixture(params=CASES)
def texts(request):
    return CASES[request.param]


def plain(spark, texts):
    return [(r["doc_id"], r["text"]) for r in make(spark, texts).collect()]


def test_sharding(spark, texts):
    got = sharding.shard_documents(make(spark, texts), shards=4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in plain(spark, texts))
    where, slots = defaultdict(set), defaultdict(list)
    for r in got:
        where[r["text_key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(x) == 1 for x in where.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_minimax_is_least():
    rng = random.Random(3)
    for _ in range(200):
        w, k = [rng.randint(1, 9) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)

        def least(at, k):
            return sum(w[at:]) if k == 1 else min(max(sum(w[at:j]), least(j, k - 1)) for j in range(at, len(w) + 1))

        assert sharding.minimax(w, k)[0] == least(0, k)


def test_refined_cuts_equal_the_whole_search(spark):
    rows = [(int(x), int(w), 1) for x, w in zip(np.random.default_rng(5).integers(-(2**63), 2**63, 3000), np.random.default_rng(6).integers(1, 500, 3000), strict=True)]
    rows += [((5 << 48) + k, 40, 1) for k in range(2000)]  # many groups in one first cell
    rows.sort()
    df = spark.createDataFrame(rows, "key long, bytes long, n_rows long")
    cuts = sharding._cuts(df, 7)
    capacity, _ = sharding.minimax([w for _, w, _ in rows], 7)
    loads = Counter()
    for key, w, _ in rows:
        loads[sum(key >= c for c in cuts)] += w
    assert max(loads.values()) == capacity


def test_chat(spark):
    rows = [(1, 0, "user", "a ### b \\ </turn> #"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 1, None, ""), (3, 1, "we:ird\n", "y"), (3, None, "user", "z"), (3, None, "user", "z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, segments int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "a ### b \\ </turn> #"), ("assistant", "")]
    assert [tuple(t) for t in got[3]["turns"]] == [("user", "z"), ("user", "z"), ("", ""), ("we:ird\n", "y")]
    assert (got[1]["valid"], got[2]["valid"], got[3]["valid"], got[3]["n_valid_turns"]) == (True, False, False, 1)
    assert got[2]["loss_text"] == "x" and chat.format_chats(df.limit(0)).count() == 0


def test_quality(spark, texts):
    want = {}
    for i, t in plain(spark, texts):
        t = t or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        want.setdefault(i, []).append((len(words), sum(map(len, words)), len(hit)))
    got = defaultdict(list)
    for r in quality.with_stats(make(spark, texts), "_q").select("doc_id", "_q.*").collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_repeat_words"]))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert set(quality.quality_filter(make(spark, texts)).columns) == set(make(spark, texts).columns)


def test_repeated_words_counts_the_first_too():
    h = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5], dtype=np.int64)
    assert quality.repeated_words(h) == 10


def test_packing(spark, texts):
    df = make(spark, [*texts, prose(3000, 4), "a <|endoftext|> b", "<|endoftext|>"])
    got = packing.pack_documents(df, packing.tokenizer_path()).collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for r in df.collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(r["doc_id"], k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(ids))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert [a for a, _ in x] == [sum(n for _, n in x[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 1024


def test_best_fit_takes_the_fullest_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.place(5)[0] == 2 and bins.place(6)[0] == 3 and bins.place(8)[0] == 4  # 3 closed: the fullest
    assert bins.place(5) == (2, 5)


def test_few_sequences_whatever_comes_first():
    rng = random.Random(2)
    lengths = np.array([rng.randint(550, 800) if k % 2 else rng.randint(20, 450) for k in range(20_000)])
    least = max(-(-int(lengths.sum()) // packing.LENGTH), int((2 * lengths > packing.LENGTH).sum()))
    windows = [lengths[k : k + packing.WINDOW] for k in range(0, len(lengths), packing.WINDOW)]
    seq = np.concatenate([x for x, _ in packing.place_all(iter(windows))])
    assert len(set(seq.tolist())) <= 1.01 * least and max(np.bincount(seq, lengths)) <= packing.LENGTH


def test_equal_rows_are_dealt_to_all_parts(spark):
    pieces = spark.createDataFrame([(7, 0, 0, 300, 1)] * 900, packing.PIECES).repartition(3)
    got = packing.pack_pieces(pieces, part_rows=100).collect()
    by = Counter(x["sequence_id"] >> 32 for x in got)
    assert sorted(by.values()) == [100] * 9 and len({x["sequence_id"] for x in got}) == 9 * 34
    with pytest.raises(Exception, match="longer than a sequence"):
        packing.pack_pieces(spark.createDataFrame([(7, 0, 0, 1025, 1)], packing.PIECES)).collect()


def test_line_dedup(spark):
    line = "All rights reserved."
    texts = [f"{prose(20, k)}\n {line}\n{prose(9, 50 + k)}" for k in range(12)] + [A + "\n" + B] * 12 + [None, "", "\n", line, f"{line}\n{line}"]
    df = spark.createDataFrame([(k, t, f"s{k % 12}", k, "x", 1.5, k) for k, t in enumerate(texts)], "doc_id long, text string, source string, _d1 int, _cut string, line double, h1 int")
    out = line_dedup.remove_boilerplate(df)
    assert out.columns == [*df.columns, "line_dedup"]
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == texts[0].replace(f"\n {line}", "") and got[0]["line_dedup"]["n_removed"] == 1 and got[5]["_d1"] == 5
    assert all(got[k]["text"] == texts[k] for k in range(12, 27)) and (got[27]["text"], got[28]["text"]) == ("", "")
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_counts_copies_of_a_page_once(spark):
    line = "All rights reserved. " + prose(20, 3)
    pages = [f"{line}\n{prose(5, 50 + k)}" for k in range(12)]  # mostly boilerplate, but each is a page of its own
    article = "\n".join(prose(40, 70 + k) for k in range(4))
    copies = [article] * 6 + [f"By writer {k}\n{article}" for k in range(12)]
    texts = pages + copies + [f"{line}\nthe same row twice"]
    rows = [(k, t, f"s{k % 14}") for k, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.remove_boilerplate(df).collect())
    want = [(k, t.split("\n")[1]) if k < 12 else (k, t) for k, t in enumerate(pages + copies)]
    assert got == [*want, *[(30, "the same row twice")] * 2]


def exact_classes(rows, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    n = len(rows)
    up, links = list(range(n)), [0] * n
    top = lambda x: x if up[x] == x else top(up[x])
    for a in range(n):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                up[top(a)] = top(b)
    first = defaultdict(lambda: 10**9)
    for k in range(n):
        first[top(k)] = min(first[top(k)], rows[k][0])
    return sorted((rows[k][0], first[top(k)], links[k]) for k in range(n))


def near_copies(n):
    rng, base = random.Random(8), prose(120, 7).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"w{k}"
        out.append(" ".join(w))
    return out


def test_jaccard(spark, texts):
    rows = plain(spark, texts)
    got = jaccard.near_duplicates(make(spark, texts))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == exact_classes(rows)


def test_jaccard_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    texts = near_copies(90) + [prose(60, 100 + k) for k in range(30)]
    classes = jaccard.near_duplicates
    monkeypatch.setattr(jaccard.nominated, "__defaults__", (jaccard.THRESHOLD, 16))
    got = classes(make(spark, texts))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got.collect()) == exact_classes(list(enumerate(texts)))


def test_keep_first_with_null_ids_and_odd_columns(spark):
    rows = [(None, A, 1, "a"), (None, A, 2, "a"), (7, A, 3, "b"), (None, B, 4, "c"), (None, None, 5, "d"), (9, "x y", 7, "f"), (9, "x y", 8, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key int, _doc string")
    got = jaccard.keep_first(df)
    assert got.columns == df.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted([("7", A), ("None", B), ("None", ""), ("9", "x y")])


def test_keep_first(spark):
    kept = sorted((r["doc_id"], r["text"] or "") for r in jaccard.keep_first(make(spark, ODD)).collect())
    assert kept == sorted((k, ODD[k] or "") for k in (0, 1, 2, 3, 6, 7, 10)) + [] or kept == sorted([*((k, ODD[k] or "") for k in (0, 1, 2, 3, 6, 7, 10)), (3, ODD[9][1])])


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""
    sc = spark.sparkContext

    def listed():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteBytes() for k in range(found.size())}

    before = listed()
    run()
    return sum(n for k, n in listed().items() if k not in before)


def test_keep_first_shuffles_texts_once(spark, tmp_path):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789    ") for _ in range(20_000)) for _ in range(200)]
    texts += [texts[0], texts[1] + " more", texts[2]]
    make(spark, texts).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    once = shuffled(spark, lambda: docs.repartition("doc_id").foreach(len))
    assert 0 < once < shuffled(spark, lambda: jaccard.keep_first(docs).write.parquet(f"{tmp_path}/kept")) < 1.4 * once
    assert sorted(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()) == list(range(200))


@pytest.mark.parametrize("most", [28, 16])
def test_sifted_keeps_all_that_may_match(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_BITS", most)
    rows = spark.range(20_000).select(F.when(F.col("id") > 5, F.col("id")).alias("doc_id"), (F.col("id") * 7).alias("text_key"), F.lit("x").alias("_at"))
    wanted = rows.filter("text_key % 5 = 0").select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
    got = jaccard.sifted(rows, wanted)
    kept = {r["text_key"] for r in got.collect()}
    assert got.columns == rows.columns and kept >= set(range(0, 140_000, 35)) and len(kept) < 6000
    assert jaccard.sifted(rows, wanted.limit(0)).count() == 0


def test_sifted_raises_few_false_alarms(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") * 7).alias("text_key"))
    wanted = rows.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"))
    kept = {r["doc_id"] for r in jaccard.sifted(rows, wanted).collect()}
    assert kept >= set(range(0, 20_000, 10)) and len(kept) < 2100


def test_near_duplicates_shuffles_little(spark, tmp_path):
    rng = random.Random(9)
    texts = [prose(400, 500 + k) for k in range(500)]
    texts += [" ".join("new" if rng.random() < 0.005 else w for w in t.split()) for t in texts[:250]]
    make(spark, texts).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    once = shuffled(spark, lambda: docs.select("doc_id", "text").repartition("doc_id").foreach(len))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
    try:
        assert 0 < shuffled(spark, lambda: jaccard.near_duplicates(docs).write.parquet(f"{tmp_path}/found")) < 2.2 * once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(f"{tmp_path}/found").collect()
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == exact_classes(list(enumerate(texts)))


def test_unstage_asks_for_files_once(spark, monkeypatch):
    frames = [common.stage(spark.range(9), "some") for _ in range(4)]
    asked, ask = [], type(frames[0]).inputFiles
    monkeypatch.setattr(type(frames[0]), "inputFiles", lambda df: asked.append(df) or ask(df))
    before = list(common._staged)
    common.unstage(frames[1].select("id"))
    assert len(asked) == 1 and len(set(before) - set(common._staged)) == 1
    assert [f.count() for f in frames[:1] + frames[2:]] == [9, 9, 9]


def test_keep_first_with_ids_of_text(spark):
    df = spark.createDataFrame([("1", A), ("1", A), ("2", A), (None, B), (None, B)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["text"]) for r in jaccard.keep_first(df).collect()) == [("1", A), ("None", B)]


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "If Alice has 12 apples and Bob has 7 apples then how many apples do they have in total altogether now?"), (2, A), (3, None), (4, "one two")], "item_id long, text string")
    q = "If {} has {} apples and {} has {} apples then how many apples do they have in total altogether now?"
    texts = [q.format("Carol", 3, "Dave", 9), q.format("Carol", 3, "Carol", 9), B + "\n" + A + "\n" + B, None, "", "If one has apples then how many?", B, A[:30]]
    got = decontamination.contaminated(make(spark, [*texts, (2, texts[2])]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in got) == [(0, 1, False), (2, 2, True)]
    assert decontamination.decontaminate(make(spark, texts), bench).count() == 6
    assert decontamination.contaminated(make(spark, texts), bench.limit(0)).count() == 0
    assert decontamination.contaminated(make(spark, []), bench).count() == 0


def test_decontamination_by_words_alone(spark):
    items = ["Tom scored 12, 15, 9, 30, 22, 8 and 4 points in 7 games.", "Which river flows through the old town of Marl?", "red green blue", "  "]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{B} {items[0]} {B}", f"{B} {items[1]} {B}", f"{B} red, green\nblue {B}", items[0].replace("12", "13"), "Which river flows through the new town of Marl?", "red green", None]
    got = decontamination.contaminated(make(spark, texts), bench).collect()
    # text 3 is item 0 with another number: mostly slots, but its literal words suffice
    assert sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in got) == [(0, 0, True), (1, 1, True), (2, 2, True), (3, 0, False)]


def test_decontamination_with_a_crowded_filter(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BITS", 6)
    monkeypatch.setattr(decontamination, "bloom", lambda hashes, n: np.full(1, 2**64 - 1, np.uint64))  # rules nothing out
    test_decontamination(spark)


def test_decontamination_of_short_items_and_numbers(spark):
    items = ["What is 12 + 30 ?", "Tom scored 12, 15, 9, 30, 22, 8 and 4 points in 7 games.", "blue", "33 44 55"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["and so What is 45 + 17 ? yes", "x Ann scored 1, 2, 3, 4, 5, 6 and 7 points in 8 games.", "the Blue sky", "8 9 10", "What was 12", "33 44 55", None, ""]
    got = decontamination.contaminated(make(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["verbatim"]) for r in got) == [(0, 0, False), (1, 1, False), (2, 2, True), (5, 3, True)]


def test_decontamination_writes_few_items_in_few_files(spark, monkeypatch):
    kept, stage = [], decontamination.stage
    monkeypatch.setattr(decontamination, "stage", lambda df, name: kept.append(stage(df, name)) or kept[-1])
    bench = spark.createDataFrame([(1, A), (2, B), (2, B)], "item_id long, text string").repartition(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = decontamination.contaminated(make(spark, [B + " " + A, A]), bench).collect()
        assert [len(x.inputFiles()) for x in kept] in ([1], [2])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r["doc_id"], r["item_id"], r["n_windows"], r["verbatim"]) for r in got) == [(0, 1, 68, True), (0, 2, 68, True), (1, 1, 68, True)]


def test_decontamination_tells_rows_apart(spark):
    df = spark.createDataFrame([(None, A, 1, "a", 2), (None, B, 1, "a", 2), (5, A, 1, "a", 2), (5, B, 1, "a", 2), (5, B, 1, "a", 2)], "doc_id long, text string, _row int, _bad string, hash int")
    bench = spark.createDataFrame([(1, A)], "item_id long, text string")
    got = decontamination.decontaminate(df, bench)
    assert got.columns == df.columns and sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("5", B), ("5", B), ("None", B)]


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = queries.QUERIES["op9_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.95
    model = langid.build(["a", "b"], ["foo", "bar"], np.array([2, 2]))
    say = langid.Predictor(model).predict
    assert say([None, "12 !", "", "foo", "bara"])[:3] == [("und", 0.0)] * 3
    (f, b, q) = say(["Foo foo", "bara", "qq"])
    assert f[0] == "a" and b[0] == "b" and q[0] == "a" and q[1] == 0.5  # no evidence: the first by name
    assert langid.predict_language(docs.limit(0), model).count() == 0
    assert langid.Predictor(langid.train(docs.limit(0))).predict(["word"]) == [("und", 0.0)]


def test_language_scores_equal_plain_ones():
    rng = random.Random(6)
    counts = [(rng.choice("abc"), "".join(rng.choice("xyzuv") for _ in range(rng.randint(1, 7))), rng.randint(1, 9)) for _ in range(80)]
    model = langid.build([x[0] for x in counts], [x[1] for x in counts], np.array([x[2] for x in counts]))
    tables = [defaultdict(Counter) for _ in range(langid.MAX_GRAM + 1)]
    for lang, w, n in counts:
        tables[0][lang][w] += n
        m = f"<{w}>"
        for size in range(1, langid.MAX_GRAM + 1):
            for j in range(len(m) - size + 1):
                tables[size][lang][m[j : j + size]] += n

    def log(t, lang, key):
        return np.log((tables[t][lang][key] + 0.5) / (sum(tables[t][lang].values()) + 0.5 * len({k for c in tables[t].values() for k in c})))

    def score(lang, w):
        if any(w in c for c in [dict(c) for c in tables[0].values()]) and any(tables[0][x][w] for x in "abc"):
            return log(0, lang, w)
        m = f"<{w}>"
        for size in range(langid.MAX_GRAM, 0, -1):
            grams = [g for g in (m[j : j + size] for j in range(len(m) - size + 1)) if any(tables[size][x][g] for x in "abc")]
            if grams:
                return np.mean([log(size, lang, g) for g in grams])
        return 0.0

    texts = [" ".join("".join(rng.choice("xyzuvw") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    for text, (lang, p) in zip(texts, langid.Predictor(model).predict(texts), strict=True):
        total = np.array([sum(score(x, w) for w in text.split()) for x in "abc"])
        want = np.exp(total - total.max())
        assert abs(p - want.max() / want.sum()) < 1e-9 and total["abc".index(lang)] > total.max() - 1e-9


def test_language_learns_any_number_of_languages(spark):
    rows = [(f"l{k:04}", " ".join(f"w{''.join(chr(97 + int(d)) for d in str(k))}x{c}" for c in "abcdef")) for k in range(1001)]
    model = langid.train(spark.createDataFrame(rows + [rows[0]] * 500 + [("l0000", None), (None, "x")], "lang string, text string"))
    assert len(model.langs) == 1001
    assert [x for x, _ in langid.Predictor(model).predict([t for _, t in rows[::50]])] == [x for x, _ in rows[::50]]


def test_language_of_a_null_id(spark, tmp_path):
    spark.createDataFrame([(None, "foo", "a"), (1, "foo bar", "a"), (2, "foo baz", "b"), (3, None, "b")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in langid.op9_language_id(spark, str(tmp_path)).collect()}
    assert got[None]["held_out"] is True and got[3]["lang_pred"] == "und"


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(500):
        t = rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(0, 60)))
        x = t.tolist()
        order = suffix.suffix_array(t)
        assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
        common = suffix.permuted_common_prefixes(t.astype(np.uint8), order, 12) if len(x) else []
        for a, b in zip(order, order[1:], strict=False):
            m = 0
            while m < 12 and max(a, b) + m < len(x) and x[a + m] == x[b + m]:
                m += 1
            assert common[b] == m


def test_suffix_array_is_linear():
    import time

    began = time.process_time()
    for text in (np.ones(100_000, np.int64), np.tile([3, 1, 2], 30_000), np.tile(np.arange(250, 0, -1), 300)):
        order = suffix.suffix_array(text)
        rank = np.empty(len(text) + 1, np.int64)
        rank[order], rank[-1] = np.arange(len(text)), -1
        a, b = order[:-1], order[1:]
        assert ((text[a] < text[b]) | (text[a] == text[b]) & (rank[a + 1] < rank[b + 1])).all()
    assert time.process_time() - began < 5


def kept_plain(rows, width=100):
    seen, out = set(), []
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if b[k : k + width] in seen:
                cover[k : k + width] = b"\1" * width
            seen.add(b[k : k + width])
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        out.append((i, len(b), len(b) - len(kept), sum(c and not p for c, p in zip(cover, b"\0" + cover, strict=False)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("split", [1000, 2])
def test_repeats(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    monkeypatch.setattr(repeats, "_CHUNK", 1500)
    texts = [None, "", A, A, B + A[50:260] + B, A[:300] + B[100:], "x" * 700, "ñ" * 300, *near_copies(12), "ab" * 200]
    got = repeats.remove_repeats(make(spark, texts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == kept_plain(list(enumerate(texts)))
    assert repeats.remove_repeats(make(spark, [])).count() == 0


def test_repeats_of_very_large_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SPLIT", 10)
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    core, other = prose(14, 99)[:70], prose(30, 98)[:130]
    texts = [noise(60) + core + noise(60) for _ in range(150)] + [noise(30) + other + noise(50) for _ in range(150)] + [noise(30) + core + prose(14, 97)[:60] + noise(40) for _ in range(50)]
    got = repeats.remove_repeats(make(spark, texts)).drop("kept").collect()
    assert sorted(map(tuple, got)) == kept_plain(list(enumerate(texts)))


def stretches_plain(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, repeats.anchors(data, np.repeat(np.arange(len(texts)), [len(t) for t in texts]))


def test_anchors_by_blocks(monkeypatch):
    texts = [*near_copies(12), "x" * 700, A, "ab" * 200, prose(400, 6)]
    texts = [t for t in texts if t and t.isascii() and len(t) >= repeats.WINDOW]
    monkeypatch.setattr(repeats, "_BLOCK", 1 << 20)
    _, whole = stretches_plain(texts)
    monkeypatch.setattr(repeats, "_BLOCK", 150)
    _, parts = stretches_plain(texts)
    assert len(whole[0]) > 50 and all(a.dtype == b.dtype and (a == b).all() for a, b in zip(whole, parts, strict=True))


def test_only_windows_that_may_match_are_compared():
    core = prose(5, 99)[:24]
    assert len(repeats.comparable([(prose(30, k)[:60] + core + prose(30, -k)[:60]).encode() for k in range(50, 90)])[0]) == 0
    texts = [A[40:] + B, prose(9, 5) + A[50:260] + prose(9, 6), B[:150] + "changed" + B[157:], "x" * 300, "x" * 200 + "y" * 150, "y" * 120 + A[:130]]
    data, (first, after, *_) = stretches_plain(texts)
    parts = [data[a : z + repeats.WINDOW - 1].tobytes() for a, z in zip(first.tolist(), after.tolist(), strict=True)]
    windows = lambda p: [p[k : k + repeats.WINDOW] for k in range(len(p) - repeats.WINDOW + 1)]
    seen = Counter(w for p in parts for w in windows(p))
    lost = [seen[w] for p in parts for w in windows(p)]
    at, begin, end = repeats.comparable(parts)
    kept = Counter(w for k, a, z in zip(at.tolist(), begin.tolist(), end.tolist(), strict=True) for w in windows(parts[k][a:z]))
    assert max(lost) > 1 and all(kept[w] == n for w, n in seen.items() if n > 1) and sum(kept.values()) < sum(seen.values())


def test_repeats_of_null_ids(spark):
    df = spark.createDataFrame([(None, A), (9, A), (None, "short")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in repeats.remove_repeats(df).collect())
    assert got == [("9", 0), ("None", 0), ("None", len(A.encode()))]


def test_repeats_of_rows(spark):
    got = repeats.remove_repeats(make(spark, [(5, A), (5, A), (6, A)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(5, 0), (5, 0), (6, len(A.encode()))]


def test_repeats_write_few_files(spark, monkeypatch, tmp_path):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789    ") for _ in range(20_000)) for _ in range(200)]
    make(spark, [*texts, texts[0], A, A]).write.parquet(f"{tmp_path}/documents.parquet")
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "100k"}
    before, staged, write = {k: spark.conf.get(k, None) for k in conf}, [], repeats.stage
    monkeypatch.setattr(repeats, "stage", lambda df, name: staged.append((name, write(df, name))) or staged[-1][1])
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        repeats.op10_suffix_array_dedup(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert [(r["doc_id"], r["n_removed"]) for r in got.filter("n_removed > 0").sort("doc_id").collect()] == [(200, 20_000), (202, len(A))]
    assert got.count() == 203 and len(got.inputFiles()) <= 2 and all(len(df.inputFiles()) <= 3 for _, df in staged)


PAGE = "<html><body><div class='ad'>Buy this now, friend, buy it now</div><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div id=c><h1>Title</h1><p>One <b>two</b>,\n three &amp; four and quite a few more words here.<p>Second paragraph, long enough to count as text.<ul><li>a<li>b</ul></div><aside>Side</aside><div class=comments><p>Nice post</p></div><footer>&copy;</footer><script>if (a<b) {}</script></body></html>"


def test_html(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>a<p>b&nbsp;c", "t"), (4, "u", "<p>a<p>b&nbsp;c", "t"), (5, "u", "<div>" * 3000 + "deep", "t")], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_extraction.extract_pages(df).collect())
    text = "Title One two, three & four and quite a few more words here. Second paragraph, long enough to count as text. a b"
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (4, "a b c", 5), (4, "a b c", 5), (5, "deep", 4)]


def test_html_compares_whole_attribute_names():
    text = "A paragraph that is long enough to count as the text of a page, with quite a few words."
    for attr in ('data-id="nav"', 'title="hidden gems"', 'data-x="role=menu"', "data-hidden", "data-url=/p?id=ad"):
        assert html_extraction.extract(f"<html><body><div {attr}><p>{text}</p></div></body></html>") == text, attr
    linked = html_extraction.extract(f"<body><p>{text} See <a href='/the-hidden-cost'>the cost</a> and <a href=/p?id=ad>more</a>.</p></body>")
    assert linked == f"{text} See the cost and more."
    for attr in ("hidden", 'ID = "nav"', "id=nav", "class='x ad'", 'aria-hidden="true"', "title='a b'hidden"):
        assert "Gone" not in html_extraction.extract(f"<body><div {attr}><p>Gone. {text}</p></div><p>{text}</p></body>"), attr


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, step in p.STAGES[:-1]:
        out = step(spark, seen, SF)
        assert out.columns == docs.columns and out.count() <= seen.count(), name
        seen = out.cache()
    left = seen.select("doc_id", "text").collect()
    pairs = duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()
    assert not [r for r in left for (b,) in pairs if " ".join(b.split()) in " ".join((r["text"] or "").split())]
    assert len({r["doc_id"] for r in left}) == len(left)
    packed = p.run(spark, SF).groupBy("doc_id").agg(F.sum("length")).count()
    assert packed == len(left)
