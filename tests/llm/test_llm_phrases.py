"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from saddlespark.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def want(rows, least, longest, top):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in often.items():
            score, k = min((1000 * a * total[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), lang, c[p[:k]], c[p[k:]], total[lang]))
        for rank, (score, a, p, lang, l, r, n) in enumerate(sorted(rows)[:top], start=1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(rng):
    words = [f"w{k}" for k in range(12)] + ["É", "ÉCOLE", "a-b", "New", "\x00", "\x1c", " x", "\xa0"]
    sure = ["New York City", "of the end of", "w1 w1 w1 w1", "É a-b New"]
    rows = []
    for i in range(300):
        parts = [rng.choice(sure) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        text = "".join(p + rng.choice([" ", "\t", "  ", ". ", ",", "\n", " \r\n", ";\x0b", "!?"] if rng.random() < 0.2 else [" "]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "fr", None, "und"]), text))
    return rows + [(None, None), ("en", ""), ("de", " . ,"), ("xx", None), ("en", "w1 " * 3000), ("fr", "one two")] + rows[:5]


@pytest.mark.parametrize("least, longest, most", [(12, 5, 1 << 20), (3, 4, 1 << 20), (12, 5, 0), (12, 5, 60)])
def test_all_counts_are_exact(spark, monkeypatch, least, longest, most):
    monkeypatch.setattr(phrases, "MOST_NAMES", most)
    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "KEYS_HELD", 100)
    monkeypatch.setattr(phrases, "WORDS_HELD", 5)
    rows = corpus(random.Random(least))
    df = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = sorted(tuple(r) for r in phrases.collocations(df, least, longest, 40).collect())
    assert got == want(rows, least, longest, 40)


def test_empty_and_wordless_tables(spark):
    for rows in ([], [(None, None), ("en", " . ")], [("en", "a b")]):
        df = spark.createDataFrame(rows, "lang string, text string")
        assert phrases.collocations(df, 2).count() == 0


def test_further_columns_do_not_matter(spark):
    rows = [("en", "one two three. " * 5, 1, "x", 2.0)]
    df = spark.createDataFrame(rows, "lang string, text string, Name long, `words` string, `a.b` double")
    got = phrases.collocations(df, 5).select("phrase", "a", "l", "r", "n", "score").collect()
    assert [tuple(r) for r in got] == [("one two three", 5, 5, 5, 15, 3000)]


def test_products_past_64_bits(spark):
    rows = [("en", "x y " * 2_000_000)]
    r = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), 100, 2).collect()
    assert [(x.phrase, x.score) for x in r] == [("x y", 1000 * 2_000_000 * 4_000_000 // (2_000_000**2)), ("y x", 1000 * 1_999_999 * 4_000_000 // (2_000_000**2))]


def test_what_a_task_holds_does_not_grow_with_languages_and_shards(spark, monkeypatch):
    class Chunks:
        def select(self, *_):
            return self

        def mapInPandas(self, run, schema):
            return run

    monkeypatch.setattr(phrases, "KEYS_HELD", 100)
    monkeypatch.setattr(phrases, "ROWS_TOLD", 30)
    read = []

    def batches():
        for k in range(40):
            read.append(k)
            yield pd.DataFrame({"shard": [k % 8], "lang": [k % 5], "words": [np.arange(21) + 100 * k]})

    run = phrases._mined(Chunks(), spark.sparkContext.broadcast([]), 2)
    frames = []
    for f in run(batches()):
        frames.append(f)
        assert len(f) <= 30 and len(read) * 20 - sum(map(len, frames)) < 100 + 20
    assert sum(f["n"].sum() for f in frames) == 40 * 20


def test_phrases_of_a_length_are_mined_once(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "u v w x", "en") for k in range(40)] + [(40 + k, "u v. w", "de") for k in range(40)], "doc_id long, text string, lang string")
    plans = []
    real = phrases.stored

    def told(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df)

    monkeypatch.setattr(phrases, "stored", told)
    found, _ = phrases.frequent_phrases(docs, 10, 4)
    assert {(r.lang, r.phrase): r.a for r in found.filter("size(words) > 1").collect()} == {
        ("en", p): 40 for p in ("u v", "v w", "w x", "u v w", "v w x", "u v w x")
    } | {("de", "u v"): 40}
    mined = [p.count("MapInPandas") for p in plans if "key#" in p and "least#" in p and "MapInPandas" in p]
    assert mined == [1, 1, 1]
