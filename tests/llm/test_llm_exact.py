"""Exact dedup by radix partitioning against a dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from saddlespark.llm import exact_dedup


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def want(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        first = True
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def texts(rng):
    base = "".join(rng.choice("abcdeAB \nÉé") for _ in range(5000))
    edges = [n + d for n in (32, 128, 512, 2048) for d in (-1, 0, 1)]
    found = [None, "", " ", "a", "A", "É", "é", "iİ", "K", "k", base, base.upper(), base + "x", "x" + base]
    found += [base[:n] for n in edges] + [base[:n].swapcase() for n in edges] + [base[:n] + "~" for n in edges]
    return found + ["\x00" * n for n in (31, 32, 33)]


@pytest.mark.parametrize("first", [1, 32])
def test_rows_as_by_a_dictionary(spark, monkeypatch, first):
    monkeypatch.setattr(exact_dedup, "FIRST", first)
    rng = random.Random(first)
    pool = texts(rng)
    rows = [(i, t) for i, t in enumerate(pool * 2)] + [(7, "twice"), (7, "twice"), (None, "a"), (None, "none"), (None, "none"), (-3, "none")]
    rows += [(1000 + i, "hot text " * 30) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in exact_dedup.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=key) == sorted(want(rows), key=key)


def test_kept_rows_keep_their_columns(spark):
    rows = [(1, "Same", "x", 5), (2, "same", "y", 6), (3, None, "z", 7), (4, "", None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, Level long").withColumn("grp", F.lit(1)).withColumn("a.b", F.lit("dot"))
    out = exact_dedup.distinct_texts(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text, r.row, r.Level, r["a.b"]) for r in out.collect()) == [(2, "same", "y", 6, "dot"), (4, "", None, 8, "dot")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(df).count() == 0
    assert exact_dedup.distinct_texts(df).count() == 0


def test_long_texts_that_differ_at_their_ends(spark):
    long = "long text ü " * 30_000
    rows = [(1, long + "a"), (2, long + "b"), (3, long + "A"), (4, long)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (3, 2, False), 2: (2, 1, True), 3: (3, 2, True), 4: (4, 1, True)}


def test_a_round_reads_its_own_level(spark):
    stored = exact_dedup.digits(spark.createDataFrame([(1, "x" * 200), (2, "y")], "doc_id long, text string"))
    plan = stored.filter("level = 1").select("row", "digit")._jdf.queryExecution().toString()
    assert "EqualTo(level,1)" in plan
