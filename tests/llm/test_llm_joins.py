"""Similarity joins, line dedup, license scans, page text, search and the pipeline against plain loops."""

import random
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_queries import compare, connect
from saddlespark.llm import edits, forest, licenses, line_dedup, lists, ngram_join, pages, sql
from saddlespark.llm.components import components, merged

SF = "/root/testdata/sf0.001"


def join_up(n, pairs):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


# ---- components ------------------------------------------------------------------------
def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + k, 101 + k) for k in range(30)] + [(200, 201 + k) for k in range(40)] + [(5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = join_up(300, pairs)
    assert all(roots.get(n, n) == want[n] for n in range(300))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- n-gram join -----------------------------------------------------------------------
def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    pairs = []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= percent * len(a | sets[j]):
                pairs.append((i, j))
    return sets, join_up(len(texts), pairs)


def family(rng, size, copies, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k, percent, light", [(4, 85, None), (5, 80, None), (4, 85, 0), (4, 85, 16)])
def test_join_finds_every_link(spark, monkeypatch, k, percent, light):
    rng = random.Random(k)
    texts = [None, "", " \n", "one", "one two", "ONE\ttwo", "one two three", "a " * 50]
    for size in (5, 9, 10, 12, 14, 17, 25, 60, 300):
        texts += family(rng, size, 12, max(1, size // 40)) + family(rng, size, 3, 6)
    texts += [f"{t} tail {i}" for i, t in enumerate(texts[20:60])] + texts[8:30] + ["x " + "long words here " * 4000]
    if light is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda mean, p: light)
    monkeypatch.setattr(lists, "BLOCK", 4)
    sets, root = linked(texts, k, percent)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sid string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, k, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_distinct_documents(spark):
    rows = [(3, "a b c d e f g h", 1), (1, "A b c d e f g h", 2), (1, "A b c d e f g h", 2), (None, "a b c d e f g h", 3), (5, None, 4), (6, "", 5), (7, "q r s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _turn int")
    kept = ngram_join.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "5", "6", "7", "None"]
    assert ngram_join.distinct_documents(df.limit(0)).count() == 0


def test_distinct_documents_by_text(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(3, a), (5, a), (5, b), (9, b), (5, "k l m n o p"), (None, b), (None, b), (None, "i j k l m"), (None, "i j k l m")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in ngram_join.distinct_documents(df).collect())
    assert kept == Counter([(3, a), (5, b), (5, "k l m n o p"), (None, b), (None, "i j k l m")])


def test_subset_sizes_are_exactly_the_links():
    for percent in (80, 85):
        for n in range(1, 30):
            for m in range(1, 30):
                possible = 100 * min(n, m) >= percent * max(n, m)
                assert (m in ngram_join.partners(n, percent)) == possible
                if possible:
                    c = ngram_join.overlap(n, m, percent)
                    assert 100 * c >= percent * (n + m - c) and 100 * (c - 1) < percent * (n + m - c + 1)
                    assert ngram_join.prefix(n, percent) > n - c


# ---- line dedup ------------------------------------------------------------------------
def line_words(line):
    return [w for w in map(line_dedup.normal_word, line.split()) if w]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_bound_is_exact():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(rng.randrange(1, n)))
    for _ in range(2000):
        a = [word(4) for _ in range(rng.randrange(1, 7))]
        b = list(a)
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.choice(["a", "bc", "cab", "ü"]) for _ in range(rng.randrange(3))]
        a, b = " ".join(a), " ".join(b)
        d = distance(a, b)
        for most in range(8):
            assert line_dedup.within(a, b, most) == line_dedup.within(b, a, most) == (d <= most)
    long = "ab " * 20_000
    assert line_dedup.within(long + "c" * 50, "d" * 50 + long, 150) and not line_dedup.within(long + "c" * 50, "d" * 50 + long, 30)


def test_counts_and_columns_stop_only_lines_apart():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeü") for _ in range(rng.randrange(1, 8))) for _ in range(40)]
    told = []
    for _ in range(60):
        a = [rng.choice(words) for _ in range(rng.randrange(5, 70))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 2)):
            k = rng.randrange(len(b))
            b[k : k + rng.randrange(3)] = [rng.choice(words) for _ in range(rng.randrange(3))]
            b = b or ["x"]
        told += [" ".join(a), " ".join(b)]
    told += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(4)]
    at = np.arange(0, len(told), 2)
    near = line_dedup.Sequences(told).near(at, at + 1)
    d = [distance(told[k], told[k + 1]) for k in at]
    fits = [x <= 0.2 * max(len(told[k]), len(told[k + 1])) for k, x in zip(at, d, strict=True)]
    assert all(near[np.array(fits)]) and sum(fits) >= 10 and not near[-2:].any()
    # of 20 edits 40 sequences may stem, not 50, though all differences are no more than 80
    assert not line_dedup.Sequences(["ab" * 50, "ab" * 25 + "cdefghijklmnopqrstuvwxyz"]).near(np.array([0]), np.array([1]))[0]
    for k, x in zip(at, d, strict=True):
        for most in (x - 1, x, x // 2, 2 * x):
            assert line_dedup.within(told[k], told[k + 1], most) == (x <= most)


def test_many_edit_distances_are_bounded_at_once():
    rng = random.Random(6)
    one, two = ["", "", "abc", "a" * 64], ["", "xy", "", "a" * 65]
    for n in (1, 5, 60, 63, 64, 65, 129, 200, 300) * 12:
        letters = rng.choice(["ab", "abcd ü", "abcdefghijklmnopqrstuvwxyz \U0001f600"])
        a = [rng.choice(letters) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randrange(n // 3 + 2)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.choice(letters) for _ in range(rng.randrange(3))]
        one.append("".join(a))
        two.append("".join(b))
    d = np.array([distance(a, b) for a, b in zip(one, two, strict=True)])
    for most in (d, d - 1, d // 2, 2 * d + 1, np.full(len(d), 12)):
        for alone in (None, line_dedup.within):
            assert edits.bounded(one, two, most, alone).tolist() == (d <= most).tolist()
    fits = [x <= 0.2 * max(len(a), len(b)) for x, a, b in zip(d, one, two, strict=True)]
    assert line_dedup.alike(one, two).tolist() == line_dedup.alike(one, two, strip=True).tolist() == fits


def test_lines_of_a_list_are_settled_together_and_only_among_like_lengths(spark, monkeypatch):
    # one list of many lines apart: pairs of unlike lengths are not formed, and the others settled in few calls
    rng = random.Random(9)
    told = ["".join(rng.choice("abcdefgh") for _ in range(20 + k // 4 * 6)) for k in range(160)]
    told += [t[:-1] + "z" for t in told[::16]]
    rows = spark.createDataFrame([(1, k, len(t)) for k, t in enumerate(told)], "key long, sid long, size long")
    tell = lambda sids: sids.join(spark.createDataFrame([*enumerate(told)], "sid long, told string"), "sid")
    calls, pairs = (spark.sparkContext.accumulator(0) for _ in range(2))

    def test(rows):
        return lambda x, y: np.ones(len(rows), dtype=bool)[x]

    def near(rows):
        return lambda x, y: pairs.add(len(x)) or np.ones(len(x), dtype=bool)

    def settle(one, two):
        calls.add(1)
        return line_dedup.alike(one, two)

    roots = spark.createDataFrame([(160, 0)], "node long, root long")
    for block, most in ((lists.BLOCK, 2), (8, 400)):
        monkeypatch.setattr(lists, "BLOCK", block)
        calls.value = pairs.value = 0
        found = {(r.a, r.b) for r in lists.alike_across(rows, roots, tell, 0.8, test, near, settle).collect()}
        assert found == {(16 * k, 160 + k) for k in range(1, 10)}
        every = [(a, b) for k, a in enumerate(told) for b in told[:k] if min(len(a), len(b)) >= 0.8 * max(len(a), len(b))]
        assert pairs.value == len(every) - 1 < 170 * 169 / 4 and calls.value <= most


def fingerprint(weighted):
    return sum((sum(w if h >> b & 1 else -w for h, w in weighted) > 0) << b for b in range(64))


def deduped(docs):
    """The same rule by loops over all pairs of lines."""
    known = line_dedup.Words()
    places = []
    for doc, text in sorted((d, t) for d, t in docs if t is not None):
        for k, line in enumerate(text.split("\n")):
            words = line_words(line)
            if len(words) >= line_dedup.MIN_WORDS:
                ids = [known[w] for w in words]
                known.settle()
                places.append((doc, k, " ".join(words), fingerprint([(known.hash(w), max(1, len(w) - 2)) for w in words])))
                assert places[-1][3] == line_dedup.fingerprints(known.votes, np.array(ids), np.array([0]))[0]
    pairs = []
    for i, a in enumerate(places):
        for j in range(i):
            b = places[j]
            near = (a[3] ^ b[3]).bit_count() <= line_dedup.DISTANCE
            longest = max(len(a[2]), len(b[2]))
            if a[2] == b[2] or near and distance(a[2], b[2]) <= int((1 - line_dedup.SIMILARITY) * longest + 1e-9):
                pairs.append((i, j))
    root = join_up(len(places), pairs)
    gone = defaultdict(set)
    for i, p in enumerate(places):
        if root[i] != i:
            gone[p[0]].add(p[1])
    return {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in docs}, sum(map(len, gone.values()))


def test_lines_go_as_by_loops(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    bases = [" ".join(word() for _ in range(n)) for n in (6, 12, 30, 60, 60, 80)]

    def variant():
        words = rng.choice(bases).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = word()
        return rng.choice([str, str.upper, str.title])(" ".join(words)) + rng.choice(["", ".", "!"])

    docs = [(k, "\n".join(rng.choice([variant(), " ".join(word() for _ in range(9)), "short line", ""]) for _ in range(5))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "short line"), (103, bases[3] + "\n" + bases[3]), (104, "\n".join(bases))]
    monkeypatch.setattr(lists, "BLOCK", 4)
    want, removed = deduped(docs)
    df = spark.createDataFrame([(d, t, 7, "g") for d, t in docs], "doc_id long, text string, doc int, gone string").repartition(3)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "lines_removed"]
    rows = out.collect()
    assert {r.doc_id: r.text for r in rows} == want and sum(r.lines_removed for r in rows) == removed > 20
    assert line_dedup.dedup_lines(df, drop_emptied=True).filter("doc_id = 103 OR doc_id = 101").count() == 1
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_and_nameless_documents_come_out_alike(spark):
    line = "these are seven words in one line"
    df = spark.createDataFrame([(1, line), (1, line), (None, line), (2, line + "\nother")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    assert sum(got.values()) == 4 and got[2, "other"] == 1 and got[1, line] + got[None, line] in (1, 2)


def test_changed_lines_go_as_by_edit_similarity_alone(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10)))
    lines = []
    for n in (8, 12, 20, 20, 30, 60, 60, 150) * 4:
        base = [word() for _ in range(n)]
        other = list(base)
        for k in rng.sample(range(n), max(1, n // 8)):
            other[k] = word()
        lines += [" ".join(base), " ".join(other)]
    want = sum(distance(a, b) <= 0.2 * max(len(a), len(b)) for a, b in zip(lines[::2], lines[1::2], strict=True))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = [r.doc_id for r in line_dedup.dedup_lines(df).filter("lines_removed = 1").collect()]
    # the first line of a pair always stays, and nearly every other one that is alike goes
    assert all(i % 2 and distance(lines[i - 1], lines[i]) <= 0.2 * max(map(len, lines[i - 1 : i + 1])) for i in got)
    assert want >= 25 and len(got) >= 0.95 * want


def test_lines_are_told_by_number_alone(spark):
    texts = ["ΑΣ ΒΣ. one (Two) THREE four\nshort\nthe second line, of «Seven» words Straße", "x\n\nİstanbul is a town of many-sided words"]
    docs = line_dedup._named(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = line_dedup.occurrences(docs).select("sid", "doc", "line").localCheckpoint()
    lines = {r.doc: r.text.lower().split("\n") for r in docs.collect()}
    want = {(r.sid, " ".join(line_words(lines[r.doc][r.line]))) for r in rows.collect()}
    told = line_dedup._told(rows.select("sid"), docs, rows)
    assert len(want) == 3 and {(r.sid, r.told) for r in told.collect()} == want


def test_rows_of_other_numbers_stay(spark):
    rows = ["1204 3381 9920 1175 6402", "5871 2093 4416 8059 7732", "bread 1.20 milk 0.95 eggs", "1204 3381 9920 1175 6402"]
    log = [f"2026-01-0{k} the nightly job of the northern office has come to its end" for k in (1, 2)]
    df = spark.createDataFrame(list(enumerate(rows + log)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    # equal numbers are a copy, other numbers are not; long lines that differ in a digit are alike by edit similarity
    assert [out[k] for k in range(6)] == [*rows[:3], "", log[0], ""]
    assert sorted(r.doc_id for r in line_dedup.dedup_lines(df, drop_emptied=True).collect()) == [0, 1, 2, 4]


# ---- licenses --------------------------------------------------------------------------
def test_license_labels(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and the documentation files"
    rows = [
        (1, "Released UNDER the\tMIT-License; under the mit license"), (2, "Apache License, Version 2.0 ... CC BY-NC"), (3, gpl), (4, "x " * 300 + mit),
        (5, None), (6, "..."), (7, "under the mit licensed"), (7, gpl), (7, gpl), (None, "the license of the software and the copy"), (8, "é" + "a " * 9000 + "cc by nc"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(df).collect()), key=str)
    assert (1, 9, 2, 1, 5, "mit", "mit") in got
    assert (2, 8, 2, 0, 5, "apache-2,cc-by-nc", "apache-2,cc-by-nc") in got
    assert (3, 12, 0, None, None, "", "gpl") in got and got.count((7, 12, 0, None, None, "", "gpl")) == 2
    assert [g[-1] for g in got if g[0] == 4] == ["mit"]
    assert (5, 0, 0, None, None, "", "") in got and (6, 0, 0, None, None, "", "") in got and (7, 4, 0, None, None, "", "") in got
    assert (8, 9004, 1, 9001, 9001, "cc-by-nc", "cc-by-nc") in got or (8, 9003, 1, 9000, 9000, "cc-by-nc", "cc-by-nc") in got
    assert licenses.scan(df.limit(0)).count() == 0


def test_templates_are_told_apart(spark):
    by = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    texts = [t for _, t in licenses.TEMPLATES] + [by.format(x) for x in ("-ShareAlike", "-NonCommercial", "-NonCommercial-ShareAlike", "")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    want = [label for label, _ in licenses.TEMPLATES] + ["cc-by-sa", "cc-by-nc", "cc-by-nc,cc-by-sa", ""]
    assert [got[k] for k in range(len(texts))] == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(list(enumerate(texts)), columns=["doc_id", "text"]))
    rows = con.sql(sql.license_scan()).df()
    assert dict(zip(rows["doc_id"], rows["labels"], strict=True)) == dict(enumerate(want))


# ---- pages -----------------------------------------------------------------------------
def test_page_text_and_templates(spark):
    def page(k, extra="", tail="</article></body></html>"):
        return (
            f"<html><head><title>t</title><style>p{{}}</style></head><body><header>Site</header><nav><a href=/>menu</a></nav>"
            f"<div class='cookie-notice'>we use cookies</div><article><h1>Title {k}</h1><p>Text &amp; more {k}<br>of  it<p>second &lt;b&gt; {k}"
            f"<div><span>Read our paper every day</span></div>{extra}<div class=comments><p>nice</div>{tail}<footer>end</footer>"
        )

    rows = [(k, f"http://h.example/{k}", page(k), 1) for k in range(12)]
    rows += [(50, "http://other.example/1", page(50), 1), (51, None, page(51), 1), (52, "x", None, 1), (53, "http://h.example/z", "", 1), (54, "http://h.example/q", page(54, tail=""), 1)]
    rows += [(60 + k, "http://h.example/m", page(60, "<div>mirrored block</div>"), 1) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, template int")
    got = {r.page_id: r.text for r in pages.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Title 3\n\nText & more 3 of it\n\nsecond <b> 3" and got[54] == "Title 54\n\nText & more 54 of it\n\nsecond <b> 54"
    assert got[50].endswith("Read our paper every day") and got[51].endswith("every day")
    assert got[60].endswith("mirrored block") and "every day" not in got[60]
    assert got[52] == "" and got[53] == ""
    assert pages.extract(df.limit(0)).count() == 0


def test_names_of_headings_and_sections_keep_their_text(spark):
    body = (
        '<h2 id="related-work">Related work</h2><section id="comment-period"><p>the period</p></section><p id="notice-2">second notice</p>'
        '<div class="response alert-levels">levels</div><p class="notice">a notice</p><p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>'
        '<div class="big comments">nice</div><ul role="navigation"><li>menu</ul>'
    )
    for around in ("article", "main"):
        source = f'<body><div id="cookie-notice">cookies</div><{around}>{body}</{around}></body>'
        assert pages.Page(source).main_text() == "Related work\n\nthe period\n\nsecond notice\n\nlevels\n\na notice\n\nso x=1"


@pytest.mark.parametrize("most", [pages.BROADCAST_HASHES, 0])
def test_template_on_few_pages_of_a_large_host(spark, monkeypatch, most):
    monkeypatch.setattr(pages, "BROADCAST_HASHES", most)
    box = "<div><span>members read more</span></div>"
    rows = [(k, "http://h.example/x", f"<article><p>Text {k}</p>{box if k % 20 == 0 else ''}</article>") for k in range(200)]
    rows += [(300, "http://o.example/x", f"<article><p>Text</p>{box}</article>"), (301, None, f"<article>{box}</article>"), (302, "x", None)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the box is on ten of 200 pages of the host
    assert all(got[k] == f"Text {k}" for k in range(200))
    assert got[300] == "Text\n\nmembers read more" and got[301] == "members read more" and got[302] == ""


# ---- search ----------------------------------------------------------------------------
@pytest.mark.parametrize("leaf", [4096, 64])
def test_search_recall(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF", leaf)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centers] + [rng.normal(size=(300, 16)), np.repeat(rng.normal(size=(1, 16)), 90, axis=0)])
    x *= rng.uniform(0.5, 2, size=(len(x), 1))
    x[-90:] = x[-1]
    rows = [(i, [float(np.float32(v)) for v in r], 1) for i, r in enumerate(x)]
    bad = [(2000, None, 1), (2020, [0.0] * 16, 1), (2040, [float("nan")] * 16, 1), (2060, [None] + [1.0] * 15, 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, dim int")
    got = defaultdict(list)
    for r in forest.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    m = np.array([r[1] for r in rows])
    asked = list(range(0, len(x), 20))
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        scores = m @ m[q]
        order = [i for i in np.lexsort((np.arange(len(m)), -np.round(scores, 12))) if i != q][:20]
        found = [v for _, v, _ in got[q]]
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and q not in found
        assert np.allclose([s for _, _, s in got[q]], scores[found], rtol=0, atol=1e-12)
        hits += len(set(order) & set(found))
    assert hits >= 0.9 * 20 * len(asked)
    copies = [v for _, v, _ in got[asked[-1]]]
    assert copies == [i for i in range(len(x) - 90, len(x)) if i != asked[-1]][:20]
    assert forest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ---- queries and pipeline ----------------------------------------------------------------
@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.text_sql()))
def test_query_with_sql(spark, con, name):
    outcome, _ = compare(spark, con, name, SF)
    assert outcome.startswith("ok"), outcome


def test_join_query_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    sets, root = linked([d.text for d in docs], 4, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in entry.queries()["op9_ngram_join"](spark, SF).collect()}
    assert got == {d.doc_id: (len(s), docs[k].doc_id) for d, s, k in zip(docs, sets, root, strict=True)}


def test_pipeline_stages_work_on_what_is_kept(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mix_sources", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "pack":
            assert docs.columns == columns
        if name == "quality_rules":
            assert docs.exceptAll(before).count() == 0 and kept[1] < kept[0]
        if name == "line_dedup":
            lines = docs.select(F.explode(F.split("text", "\n")).alias("l")).filter("size(split(l, ' ')) >= 8")
            assert lines.count() == lines.distinct().count()
        if name == "ngram_jaccard":
            _, root = linked([r.text for r in docs.collect()], 5, 80)
            assert root == list(range(len(root)))
        if name == "mix_sources":
            assert docs.distinct().count() <= kept[3] and docs.select("doc_id").distinct().join(before, "doc_id", "left_anti").count() == 0
    assert docs.agg(F.sum("length")).first()[0] > 0
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def _names(path):
    import os

    return {f for f in os.listdir(path.removeprefix("file:")) if f.startswith("table-")}


def test_stored_tables_leave_no_shuffle_behind_and_can_go(spark):
    from saddlespark.llm.common import discard, stored
    from saddlespark.session import shared_folder

    seen, folder = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None), shared_folder(spark)
    before = _names(folder)
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = blocks.getAllFiles()
        names = {files.apply(k).getName() for k in range(files.size())}
        return {f for f in names if f.startswith("shuffle_")}

    old = shuffles()
    table = stored(spark.range(2000).repartition(3, "id").groupBy("id").count())
    deadline = time.time() + 20
    while (left := shuffles() - old) and time.time() < deadline:  # files go in the background
        time.sleep(0.2)
    assert not left and table.count() == 2000 and len(_names(folder) - before) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == seen
    discard(table)
    assert _names(folder) == before


def test_settled_lists_hand_on_links_and_not_all_pairs(spark):
    n = 700  # more than a block
    rows = spark.createDataFrame([(k, s) for k in (1, 2) for s in range(n)], "key long, sid long")
    roots = spark.createDataFrame([], "node long, root long")
    test = lambda rows: lambda x, y: np.ones(len(x), dtype=bool)

    def settle(rows):
        sid = rows["sid"].tolist()
        return lambda x, y: sid[x] % 2 == sid[y] % 2

    found = {(r.a, r.b) for r in lists.pairs_across(rows, roots, lambda sids: sids, test, settle).collect()}
    assert all(a < b and (b - a) % 2 == 0 for a, b in found) and len(found) < 10 * n
    parts = {r.node: r.root for r in components(spark.createDataFrame([*found], "a long, b long")).collect()}
    assert [parts.get(k, k) for k in range(n)] == [k % 2 for k in range(n)]
    every = lists.pairs_across(rows.filter("key = 1 AND sid < 60"), roots, lambda sids: sids, test).count()
    assert every == 60 * 59 // 2


def test_links_of_a_task_are_handed_on_once(spark):
    # fifty lists with the same members come in several batches of one task
    n, seen = 40, spark.sparkContext.accumulator(0)
    rows = spark.range(50 * n).selectExpr(f"id div {n} AS key", f"id % {n} AS sid")
    roots = spark.createDataFrame([], "node long, root long")
    test = lambda rows: lambda x, y: np.ones(len(x), dtype=bool)

    def settle(rows):
        def holds(x, y):
            seen.add(1)
            return True

        return holds

    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, v in zip(before, ("1", "100"), strict=True):
        spark.conf.set(k, v)
    try:
        found = lists.pairs_across(rows, roots, lambda sids: sids, test, settle).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len({(r.a, r.b) for r in found}) == len(found) == seen.value == n - 1


def test_blocks_by_size_find_the_same_links(spark):
    n = 60
    rows = spark.range(n).selectExpr("1L AS key", "id AS sid", "id % 7 * 50 AS size")
    roots = spark.createDataFrame([(3, 0), (6, 0), (4, 1)], "node long, root long")
    test = lambda rows: lambda x, y: np.ones(len(x), dtype=bool)

    def settle(rows):
        sid = rows["sid"].tolist()
        return lambda x, y: sid[x] % 3 == sid[y] % 3

    links = lists.pairs_across(rows, roots, lambda sids: sids, test, settle, 200)
    parts = {r.node: r.root for r in merged(roots, links).collect()}
    assert [parts.get(k, k) for k in range(n)] == [k % 3 for k in range(n)]


def test_near_copies_hand_on_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    texts = family(rng, 120, 150, 9) + [" ".join(f"u{k}x{j}" for j in range(30)) for k in range(20)]
    handed, linked_pairs = [], ngram_join._linked

    def counted(pairs, *rest):
        handed.append(pairs.count())
        return linked_pairs(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_linked", counted)
    sets, root = linked(texts, 4, 85)
    close = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets[:150]) for b in sets[:i])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, 4, 85).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    # pairs are held against each other beside their sets; only those with a list's pivots are joined with them
    assert len(handed) == 1 and handed[0] < close, (handed, close)


def test_bitmaps_of_large_sets_tell_them_apart():
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    a, b, small, other = draw(6000), draw(6000), draw(700), draw(90)
    near = np.unique(np.r_[a[:5700], b[:200]])
    sets = [a, b, near, small, np.unique(np.r_[small[:670], other[:20]]), other]
    bits, n = ngram_join.Bitmaps(pd.Series([ngram_join.bitmap(s) for s in sets])), np.array([len(s) for s in sets])
    x, y = np.array([0, 0, 1, 3, 3, 5]), np.array([1, 2, 2, 4, 5, 5])
    assert bits.apart(x, y, n[x], n[y], 85).tolist() == [True, False, True, False, True, False]
