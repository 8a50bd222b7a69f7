"""Operators against plain versions of their definitions, over whole small tables; and the pipeline against a plain pipeline."""

import math
import os
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import decontamination, html_extraction, line_dedup, packing, quality, queries, sharding

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


# quality
def stats(text):
    import regex

    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))
    count = lambda p: len(regex.findall(p, text))
    of = {"signs": (count(r"[^\p{L}\p{M}\p{N}\p{Z}\s]"), base[1]), "capitals": (count(r"\p{Lu}"), count(r"\p{L}")), "stutter": (sum(a == b for a, b in zip(w, w[1:], strict=False)), len(w))}
    return base, len(w) < 10 or 100 * len(repeated) > 20 * len(w), {r: x * 10000 // (n + quality.SMOOTH[r]) for r, (x, n) in of.items()}


def sketch_limit(values):
    """From the sketch's buckets, as a plain list."""
    def value(v):
        if v <= 0:
            return 0.0
        return 2 * quality.GAMMA ** math.ceil(math.log(v) / math.log(quality.GAMMA)) / (quality.GAMMA + 1)

    s = sorted(map(value, values))
    q2, q3 = (s[math.ceil(len(s) * q) - 1] for q in (0.5, 0.75))
    return q3 + quality.SPREAD * max(q3 - q2, q3 * (quality.GAMMA - 1))


def plain_quality(docs):
    """docs: (doc_id, text, lang, source) -> [(base, failed, kept)]."""
    found = [stats(t) for _, t, _, _ in docs]
    groups = {level: defaultdict(lambda: defaultdict(list)) for level in range(3)}
    for (_, _, lang, source), (_, failed, ratios) in zip(docs, found, strict=True):
        if not failed:
            for level, key in enumerate([(), (lang or "",), (lang or "", source or "")]):
                for r, v in ratios.items():
                    groups[level][key][r].append(v)
    out = []
    for (_, _, lang, source), (base, failed, ratios) in zip(docs, found, strict=True):
        kept = not failed
        for r, v in ratios.items() if kept else ():
            limit = sketch_limit(groups[0][()][r])
            for level, key in ((1, (lang or "",)), (2, (lang or "", source or ""))):
                own = groups[level][key][r]
                limit = (len(own) * sketch_limit(own) + quality.WEIGHT * limit) / (len(own) + quality.WEIGHT)
            kept = kept and v <= math.floor(limit)
        out.append((base, failed, kept))
    return out


def documents(sf=SF):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet' order by doc_id").fetchall()


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_quality_equals_a_plain_version(spark, sf):
    docs = documents(sf)
    want = [(d[0], *base, failed, kept) for d, (base, failed, kept) in zip(docs, plain_quality(docs), strict=True)]
    got = quality.op3_quality_rules(spark, sf).select("doc_id", *quality.BASE, "base_failed", "kept").collect()
    assert sorted(map(tuple, got)) == want
    assert 0 < sum(not x[-1] for x in want) < len(want) / 3


def test_quality_limits_differ_by_group(spark):
    s = quality.with_stats(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "q")
    limits = [x["limits"] for x in quality.thresholds(quality.sketches(s, "q")).collect()]
    assert len(limits) == 80 and all(len({x[r] for x in limits}) > 10 for r in quality.RATIOS)


def test_sketches_merge_in_any_order(spark):
    s = quality.with_stats(spark.read.parquet(f"{SF}/documents.parquet"), "q").cache()
    whole = quality.sketches(s, "q")
    halves = [quality.sketches(s.filter(F.col("doc_id") % 2 == k), "q") for k in (1, 0)]
    merged = halves[0].unionByName(halves[1]).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, merged.collect()))


def test_quality_with_odd_columns_ties_and_empty_groups(spark):
    line = "one two three four five six seven eight nine ten, eleven."
    rows = [(k, line, None if k % 2 else "en", "s", 1, "a", 2, 3, True) for k in range(6)] + [(6, "x", "only short texts", "t", 1, "a", 2, 3, True), (None, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, limits int, _gl string, _stats int, _limits int, _kept boolean")
    got = quality.quality_filter(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == list(range(6))  # all tie at the limit
    assert quality.quality_filter(df.limit(0)).count() == 0


ODD = [
    None, "", " \n\t\v\f\r \n", "one", "a\u00a0b\u2003c\x85d \x1ce\u3000f", "\n\n x\nx\r\nx\n x\n\x1c\n\x1c", "Ab \u01c5 \u00c9\u00e9 \u0301 \u216b \u0661 \U0001d400\U0001f600 $#*%&|<> \u20ac+",
    "x" * 3000, "a b c d e " * 40 + "f", "so so so " * 5, "\u00e9\n" * 50, "\ufeff \x00 \u200b\ufffd",
]


def test_quality_of_odd_texts(spark):
    import regex

    def plain_stats(text):  # white space that is no sign is ASCII only, as in the SQL
        base, failed, ratios = stats(text)
        signs = len(regex.findall(r"[^\p{L}\p{M}\p{N}\p{Z}\x09-\x0D]", text or ""))
        return (*base, failed, signs * 10000 // (base[1] + quality.SMOOTH["signs"]), ratios["capitals"], ratios["stutter"])

    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(ODD)], "doc_id long, text string, lang string, source string").repartition(3)
    got = quality.with_stats(df, "q").orderBy("doc_id").select([f"q.{n}" for n in quality.BASE] + ["q.base_failed", "q.ratios.*"]).collect()
    assert [tuple(r) for r in got] == [plain_stats(t) for t in ODD]


@pytest.mark.parametrize("text", [t for t in ODD if t])
def test_quality_counts_in_parts_as_at_once(text):
    raw = text.encode()
    for size in (1, 2, 7):
        assert (quality.character_kinds(raw, size) == quality.character_kinds(raw)).all()
        assert (quality.text_hashes(raw, size) == quality.text_hashes(raw)).all()
    assert len(quality.text_hashes(raw)) == len(words(text))


def test_quality_reads_few_rows_at_once(spark, monkeypatch):
    key, seen, stage = "spark.sql.parquet.columnarReaderBatchSize", {}, quality.stage
    monkeypatch.setattr(quality, "stage", lambda df, name: seen.setdefault(name, int(spark.conf.get(key))) and stage(df, name))
    before = spark.conf.get(key)
    for run in (lambda: quality.op3_quality_rules(spark, SF), lambda: quality.quality_filter(spark.read.parquet(f"{SF}/documents.parquet"))):
        seen.clear()
        run()
        assert seen["stats"] <= 512 and spark.conf.get(key) == before


LONG = """
from pyspark.sql import SparkSession, functions as F
from pitspark.llm import quality
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
docs = spark.range(1).select(F.expr("repeat('a b ', 4000000 + cast(id AS int))").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
print("words", quality.with_stats(docs, "q").select("q.n_words", "q.word_chars", "q.n_repeat_words").first())
"""


def test_quality_splits_no_text_in_the_jvm():
    """Eight million words of one text are some gigabyte of strings in a JVM; this one has 600 MB."""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell", "PYSPARK_PYTHON": sys.executable}
    ran = subprocess.run([sys.executable, "-c", LONG], env=env, capture_output=True, text=True, timeout=300)
    assert "words Row(n_words=8000000, word_chars=8000000, n_repeat_words=8000000)" in ran.stdout, ran.stderr[-2000:]


# extraction
def plain_choice(tree):
    """Densities, sums and the kept nodes by the definitions, each node's subtree looked at anew."""
    n = len(tree.names)
    inner = [[c for c in range(1, n) if tree.parent[c] == i and not tree.dropped[c]] for i in range(n)]
    below = lambda i: [i, *(x for c in inner[i] for x in below(c))]
    own = [sum(len(t.strip()) for k, t in tree.pieces if t is not None and k == i) for i in range(n)]
    chars = lambda i: sum(own[x] for x in below(i)) if not tree.dropped[i] else 0
    linked = lambda i: chars(i) if tree.names[i] == "a" else sum(linked(c) for c in inner[i])
    body = tree.names.index("body") if "body" in tree.names else 0
    lean = linked(body) / max(1, chars(body))
    articles = [x for x in below(0) if tree.names[x] in ("article", "main") and chars(x)]

    def above(i):
        return [i] if i == 0 else [i, *above(tree.parent[i])]

    def density(i):
        c = chars(i)
        if tree.dropped[i] or not c:
            return 0.0
        # tags of links: the links below a node, or what a link itself holds
        lt = len(below(i)) - 1 if tree.names[i] == "a" else link_tags(i)
        base = math.log(c / max(1, c - linked(i)) * linked(i) + lean * c + math.e)
        d = c / max(1, len(below(i)) - 1) * max(0.0, math.log(max(1.0, c / max(1, linked(i)) * max(1, len(below(i)) - 1) / max(1, lt)))) / base
        elsewhere = [a for a in articles if a not in below(i) and a not in above(i)]
        return d * html_extraction.PRIOR if tree.prior[i] and (c < html_extraction.MOST[tree.prior[i]] * chars(body) or elsewhere) else d

    def link_tags(i):
        return sum((len(below(c)) - 1 if tree.names[c] == "a" else link_tags(c)) + (tree.names[c] == "a") for c in inner[i])

    d = [density(i) for i in range(n)]
    total = [sum(d[c] for c in inner[i] if tree.names[c] not in html_extraction.INLINE) for i in range(n)]
    best = lambda i: max(below(i), key=lambda x: (total[x], -x))
    top = best(0) if total[best(0)] > 0 else body
    threshold, up = d[top], top
    while up not in (body, 0):
        up = tree.parent[up]
        threshold = min(threshold, d[up])
    chosen = {top} | {best(i) if total[best(i)] > 0 else i for i in range(body, n) if not tree.dropped[i] and 0 < d[i] >= threshold}
    kept = []
    for i in range(n):
        low = any(tree.prior[x] and d[x] < threshold for x in above(i))
        kept.append(not tree.dropped[i] and not low and any(x in chosen for x in above(i)))
    return kept


def test_extraction_equals_a_plain_version():
    pages = [h for (h,) in duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall()]
    odd = ["<div class=ad>short</div><div class='comments'><p>one</p></div>text", "<main><div class='related'><a href=x>l</a></div><p>text of it</p></main>", "<p>a</p><p>b</p>", "<a>all link</a>", "<div><p>same</p></div><div><p>same</p></div>"]
    for page in pages + odd:
        tree = html_extraction.parse(page)
        assert html_extraction.choose(tree) == plain_choice(tree), page[:200]


def test_extraction_drops_what_surrounds_the_article_and_keeps_its_wrapper():
    long, more = "A paragraph that is long enough to count as the text of a page, with quite a few words. " * 3, "Another paragraph of the same article which goes on about the matter for a while."
    for name in ("content no-sidebar", "post comments-open", "entry with-share", "hentry has-related", "container with-nav"):
        got = html_extraction.extract(f"<body><nav><a href=/>x</a></nav><div class='{name}'><h1>Title</h1><p>{long}</p><p class='reply'>{more}</p></div><div class=sidebar><p>Gone: {more}</p></div></body>")
        assert got == f"Title {long.strip()} {more}", name
    for extra in ("<div class='comments'><b>Joe</b><p>Gone, nice article, thanks a lot.</p></div>", f"<section id='comments'><p>Gone {more}</p></section>", "<div class='cookie-notice'>Gone we use cookies to do this and that.</div>", "<aside>Gone</aside>", "<form><label>Gone</label></form>", f"<div id=sidebar><p>Gone {more}</p></div>"):
        for tag in ("article", "div", "main"):
            for page in (f"{extra}<{tag}><h1>T</h1><p>{long}</p><p>{more}</p></{tag}>", f"<{tag}><h1>T</h1><p>{long}</p><p>{more}</p>{extra}</{tag}>"):
                assert html_extraction.extract(f"<html><body><header>Gone</header>{page}<footer>Gone</footer></body></html>") == f"T {long.strip()} {more}", (extra, tag)


def test_extraction_is_linear_in_the_page():
    n, began = 20_000, time.process_time()
    for page in ("<div>" * n + "x", '<a "' * n, '<a b=">"' * n, "<div>" * n + "</span>" * n, "<b>" * n + "<div>x</div>" * n, "<ul><li>" * n, "<tr><td>" * n, "<!--" * n, "<a href='x>" * n):
        html_extraction.extract(page)
    assert time.process_time() - began < 12


# decontamination
def plain_pairs(docs, items):
    """(doc, item) by words alone and by templates, each pair of windows compared."""
    def tokens(text):
        out = []
        for line in (text or "").split("\n"):
            first = True
            for w in line.split():
                inner, start, ends = decontamination.canonical(w)
                if start:
                    out.append((start if first else inner, start, decontamination.literal(w), decontamination._EDGE.sub("", w).lower()))
                    first = ends
                else:
                    first = first or ends
        return out

    def windows(t, width):
        for i in range(len(t) - width + 1):
            here = t[i : i + width]
            template = (here[0][1], *(x[0] for x in here[1:]))
            yield i, tuple(x[2] for x in here), template, tuple(v for x, (*_, v) in zip(template, here, strict=True) if x[0] == "<")

    known = [(k, tokens(t)) for k, t in items]
    read = [(k, tokens(t)) for k, t in docs]
    found = set()
    for item, t in known:
        width = min(decontamination.WINDOW, len(t))
        if not width:
            continue
        own = list(windows(t, width))
        plain, shaped = defaultdict(list), defaultdict(list)
        for at, w, template, slots in own:
            plain[w].append(at)
            if slots and width - len(slots) >= max(decontamination.LITERALS, -(-width // decontamination.LITERAL_SHARE)):
                shaped[template].append((at, slots))
        for doc, d in read:
            passages = defaultdict(list)
            for at, w, template, slots in windows(d, width):
                if w in plain:
                    found.add((doc, item))
                for there, theirs in shaped.get(template, ()):
                    passages[at - there].append(list(zip(slots, theirs, strict=True)))
            for pairs in passages.values():
                both = {x for p in pairs for x in p}
                if len(both) == len({a for a, _ in both}) == len({b for _, b in both}) or any(all(a == b for a, b in p) for p in pairs):
                    found.add((doc, item))
    return found


def test_decontamination_equals_a_plain_version(spark):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    docs = [(k, t) for k, t, *_ in documents()]
    questions = ["Anna has 12 apples and Bob has 7 km of rope, so how many have they?", "Is 3 + 4 equal to 7 ?", "Who won in 1998?"]
    items += [(900 + k, q) for k, q in enumerate(questions)]
    docs += [(10**6, "Here: Carl has 3 apples and Dora has 9 km of rope, so how many have they? Yes."), (10**6 + 1, "Here: Carl has 3 apples and Dora has 3 km of rope, so how many have they?"), (10**6 + 2, "so Is 5 + 6 equal to 9 ? no"), (10**6 + 3, "who won in 2004?"), (10**6 + 4, None)]
    want = plain_pairs(docs, items)
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    assert {(10**6, 900), (10**6 + 2, 901), (10**6 + 3, 902)} <= want and (10**6 + 1, 900) not in want


# sharding
def test_sharding_capacity_is_the_least_of_its_order(spark):
    got = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"), shards=7).collect()
    loads, groups, rows = Counter(), Counter(), Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
        groups[r["text_key"]] += r["size"]
        rows[r["shard"]] += 1
    light, left, rest = dict(groups), 7, sum(groups.values())
    for key, w in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        if left == 1 or w * left <= rest:
            break
        light.pop(key)
        rest, left = rest - w, left - 1
    least, _ = sharding.minimax([light[k] for k in sorted(light)], left)
    heavy = [w for k, w in groups.items() if k not in light]
    assert max(loads.values()) == max([least, *heavy]) and sum(rows.values()) == 200


# the pipeline
def near_groups(docs):
    sets = [(k, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set()) for k, t in docs]
    up = {k: k for k, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and len(x & y) >= 0.8 * len(x | y):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {k for k in up if top(k) == k}


def test_pipeline_equals_a_plain_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = documents()
    docs = [d for d, (*_, kept) in zip(docs, plain_quality(docs), strict=True) if kept]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(k, t, s) for k, t, _, s in docs])
    cut = con.sql(line_dedup.OP5_SQL.replace("sha256(CASE WHEN n_removed > 0 THEN kept ELSE o.text END) AS text_sha256", "CASE WHEN n_removed > 0 THEN kept ELSE o.text END AS text")).df()
    docs = sorted(zip(cut["doc_id"].tolist(), cut["text"].tolist(), strict=True))
    heads = near_groups(docs)
    docs = [d for d in docs if d[0] in heads]
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in plain_pairs(docs, items)}
    docs = [d for d in docs if d[0] not in bad]
    own, want = Tokenizer.from_file(packing.tokenizer_path()), []
    for k, t in docs:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        want += [(k, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(ids))]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and bad and len(heads) < len(cut)
    by = defaultdict(int)
    for r in got:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= 1024 and len(by) <= 1.05 * -(-sum(x[3] for x in want) // 1024) + 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from pitspark.llm import common

    session = lambda master, folder: N(conf=N(get=lambda key, other: folder), sparkContext=N(master=master))
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(session("spark://host:7077", None))
    assert common.shared_dir(session("spark://host:7077", "hdfs://x/y/")) == "hdfs://x/y" and common.shared_dir(session("local[2]", None)).startswith("file:")
