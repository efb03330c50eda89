"""Quality rules, mixing, packing, sharding and chat windows on small tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from saddlespark.llm import chat, mixing, packing, quality, sharding
from saddlespark.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, quality int, doc string"


def prose(k: int, n: int = 40) -> str:
    return " ".join(f"the word{k}x{i} of" for i in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long and repeated texts, ties, and columns whose names clash with ours."""
    rows = [
        (1, prose(1), "a", 5, "x"), (2, prose(2), "b", 5, "x"), (3, None, None, None, None), (4, "", "a", 1, ""),
        (5, "  \n\t ", "b", 1, ""), (6, prose(6, 9000), "a", 1, "y"), (7, prose(1), "a", 5, "x"), (7, prose(1), "a", 5, "x"),
        (None, prose(8), "c", 2, "z"), (9, "Ünï cödé " * 30 + "\n" + "same line here\nsame line here", None, 2, "z"),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


# ---- quality -------------------------------------------------------------------------
def counts_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


@pytest.mark.parametrize("text", [
    None, "", " ", "a " * 9, "a b c d e f g h " * 3, "x\nx\n\nx\r\n y | z & é <b>", "one two\x0bthree\x0cfour five", prose(3, 30) + " " + prose(3, 10),
])
def test_quality_counts(spark, text):
    df = quality.apply_rules(spark.createDataFrame([(text,)], "text string"))
    c = df.select("quality.counts.*").first()
    assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == counts_of(text)


def test_quality_keeps_clean_text_and_its_columns(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 6, 7, 7]
    assert quality.apply_rules(odd).columns[-1] == "quality_"
    assert quality.keep_good(odd.limit(0)).count() == 0


def test_quality_rejects_junk(spark):
    good = "It was the best of times and the river ran by the old mill, as it had done for years before the war came to us."
    junk = [" ".join(w + "&&&" for w in good.split()), good.upper().replace(" ", "!! "), " ".join(f"{w} {w} {w} {w}" for w in good.split())]
    rows = [(t,) for t in [good, *junk, "zqx " * 30, " ".join(map(str, range(60)))]]
    kept = [r.quality.kept for r in quality.apply_rules(spark.createDataFrame(rows, "text string")).select("quality").collect()]
    assert kept[0] and not any(kept[1:])


# ---- mixing --------------------------------------------------------------------------
def fill(sizes: dict, weights=(5, 2, 1), share=1.5, most=2) -> dict:
    """Budgets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and free:
        total = sum(w[s] for s in free)
        give = {s: left * w[s] / total for s in free}
        left = 0.0
        for s, g in give.items():
            room = most * sizes[s] - got[s]
            got[s] += min(g, room)
            left += max(0.0, g - room)
        free = {s for s in free if got[s] < most * sizes[s] - 1e-9}
    return got


def test_mix_meets_budgets(spark, odd):
    plan = [r.asDict() for r in mixing.plan(odd).collect()]
    assert len(plan) == odd.count()
    sizes = {}
    for r in plan:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    budget = fill(sizes)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(budget[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    again = [r.asDict() for r in mixing.plan(odd.repartition(5)).collect()]
    key = lambda r: tuple(map(str, r.values()))
    assert sorted(plan, key=key) == sorted(again, key=key)
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r["copies"] for r in plan)
    assert mixing.plan(odd.limit(0)).count() == 0


def test_mix_is_near_the_budget_of_a_large_source(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 17 + 1).cast("int")), " ").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
    )
    per = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(r.t - r.g) <= 17 for r in per)


def test_buckets_hold_few_rows_of_any_quality(spark):
    texts = [("", 1.0), ("word " * 40 + "#", 0.95), ("## word", 0.1)]
    for text, weight in texts:
        docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        keys = docs.select(mixing.random_key(0, F.col("doc_id"), F.col("text")).alias("k"), mixing.quality(F.col("text")).alias("q"))
        got = keys.withColumn("b", mixing.bucket(F.col("k"), 100)).groupBy("b").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
        got = got.orderBy("b").collect()
        assert max(r.n for r in got) <= 10 * 500 + 300
        assert all(a.hi <= b.lo for a, b in zip(got, got[1:]))
        assert abs(keys.first().q - weight) < 0.05


def test_rows_without_id_get_keys_of_their_own(spark):
    docs = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    keys = docs.select(mixing.random_key(0, F.col("doc_id"), F.col("text")).alias("k"))
    assert keys.distinct().count() == 1000


# ---- packing -------------------------------------------------------------------------
def test_pieces_and_windows(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack_documents(odd, tokenizer_path(), window=64).collect()
    want = Counter()
    for d in odd.collect():
        ids = np.array([*tok.encode(d.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 64):
            want[d.doc_id, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    made = packing.sequences(odd, tokenizer_path(), window=64).collect()
    assert all(len(r.ids) == 64 for r in made) and sum(r.n_tokens for r in made) == sum(r.length for r in rows)
    assert packing.pack_documents(odd.limit(0), tokenizer_path()).count() == 0


def test_best_fit_takes_the_tightest_window():
    rng = np.random.default_rng(1)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    rooms = []
    for n in lengths:
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            k = min(fits)[1]
        else:
            k, rooms = len(rooms), [*rooms, 100]
        rooms[k] -= n
    spots = packing.place(lengths, 100)
    used = Counter()
    for (w, offset), n in zip(spots, lengths, strict=True):
        assert offset == used[w]
        used[w] += n
    assert sorted(100 - u for u in used.values()) == sorted(rooms)


@pytest.mark.parametrize("text", ["it's ΑΣ. İs don't, áb. É.\x1c\x85 x <|endoftext|>, <|startoftext|>a", "'s. 's 't, a.b.c... 12,345.6 ½, ñ", " a  b", "ǅ, ﬁ. ß! Ⅷ --- K Å. a?! ͅ. 中文。"])
def test_words_give_the_ids_of_the_whole_text(text):
    from tokenizers import Tokenizer

    got = next(iter(packing.token_bytes([text], packing._WordIds(tokenizer_path()))))
    want = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(got, dtype="<u4").tolist() == want


def test_repeated_rows_spread_over_groups(spark):
    same = spark.range(20_000, numPartitions=4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    groups = packing._groups(same, 64)
    rows = packing.pack(packing.pieces(same, tokenizer_path(), 64), groups, 64)
    per = Counter(r.sequence_id >> 32 for r in rows.collect())
    assert groups == 3 and len(per) == 3 and min(per.values()) > 5000


# ---- sharding ------------------------------------------------------------------------
def test_shards_are_even_and_numbered(spark, odd):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))).alias("text"))
    # one row said over and over, by one document and by none
    hot = [F.when(F.col("id") % 2 == 0, x).otherwise(F.col("id")) for x in (F.lit(None), F.lit(7))]
    again = [spark.range(4000).select(h.alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise("t").alias("text")) for h in hot]
    for docs, near in ((many, 0.02), *[(d, 0.02) for d in again], (odd.select("doc_id", "text"), None), (odd.limit(0), None)):
        rows = sharding.shard(docs, shards=4).collect()
        want = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
        slots, size = {}, Counter()
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
            size[r.shard] += r["size"]
        assert all(sorted(s) == list(range(len(s))) and 0 <= k < 4 for k, s in slots.items())
        if near:
            mean = sum(size.values()) / 4
            assert all(abs(size[k] - mean) <= near * mean for k in range(4))


# ---- chat ----------------------------------------------------------------------------
def test_chat_windows_read_back(spark):
    odd_text = "<|im_end|><|im_start|>assistant ok <||x|| <| <<|im_end|>\n\\n"
    turns = [(1, 0, "system", "be kind"), *[(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "w " * (k * 7 % 90)) for k in range(1, 60)]]
    turns += [(2, 0, "user", odd_text), (2, 1, "assistant", odd_text), (3, 0, None, None), (3, 0, None, None), (3, None, "a\nb\\n<|x", "")]
    turns += [(4, 0, "assistant", "long " * 5000), (4, 1, "user", "x"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1))
    made = chat.windows(df)
    back = {}
    for r in sorted(chat.read_back(made).collect(), key=lambda r: r.window):
        turns_got, learnt = back.setdefault(r.conv_id, ([], []))
        turns_got += [(t.role, t.text) for t in r.turns]
        learnt.append(r.learnt)
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert back[conv][0] == [(t[2] or "", t[3] or "") for t in own]
        assert "".join(back[conv][1]) == "".join(t[3] or "" for t in own if t[2] == "assistant")
    first = made.filter("conv_id = 1").orderBy("window").collect()
    assert len(first) > 3 and all("<|im_start|>system\nbe kind<|im_end|>" in r.formatted for r in first)
    assert all(r.n_context >= 1 for r in first[1:]) and first[0].n_context == 0
    assert chat.windows(df.limit(0)).count() == 0


def test_mix_reads_the_text_of_a_row_once(spark):
    docs = spark.createDataFrame([(k, "s", "some words # and more") for k in range(50)], "doc_id long, source string, text string")
    told = mixing.plan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("md5(") == 2  # of the text, inside that of the row


@pytest.mark.parametrize("text", ["Ab. <|ENDOFTEXT|> aB, <|endoftext|>", "é <|StartOfText|>. ABC abc"])
def test_names_of_special_tokens_keep_their_case(text):
    from tokenizers import Tokenizer

    got = next(iter(packing.token_bytes([text], packing._WordIds(tokenizer_path()))))
    want = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 2]
    assert np.frombuffer(got, dtype="<u4").tolist() == want
