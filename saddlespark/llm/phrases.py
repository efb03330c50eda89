"""Phrase collocations, mined by partitions (SON): locally frequent in some shard, then counted everywhere.

A phrase with at least ``min_count`` occurrences in the corpus has, in one shard at least, its
share of them: ceil(min_count * words of the shard / words of all).  So

1. words are counted; rarer ones than ``min_count`` can be in no phrase and break the text;
2. texts become numbers of words, stored in chunks, each of one of ``SHARDS`` shards (per language);
3. every shard is mined completely at its lowered support, one phrase length after the other: an
   n-gram counts only where both its (n-1)-grams are frequent.  A shard is spread over many
   tasks: each adds up what it reads before the shuffle by (shard, phrase).  The number of
   shards is fixed, so the local support, and with it the pruning, does not fall as data grow;
4. of each length the locally frequent phrases of all shards are united, less those whose known counts, with
   the most that the other shards can add, stay below ``min_count``.  These candidates are counted
   exactly over all shards, from the same shuffle, and the frequent ones lead to the next length.

Phrases are told apart by numbers, never by hashes: an n-gram is the number of its first n-1
words and that of its last word.  The sorted lists of frequent phrases go to the tasks while they
have at most ``MOST_NAMES`` entries; from the length on at which they have more, n-grams are counted as
arrays by an ordinary aggregation, and more frequent words than that are numbered by a join.

Scores are computed with decimals of 38 digits.  A candidate inside a longer one that is as frequent is left out; it is enough to
look at candidates with one word more, since those between have the same count.

Cases: null texts count as empty, a null language is ``und``; texts without words add nothing.
Very long texts are used whole.  Repeated rows count each time.  Ties in score go by
occurrences, then by the phrase's bytes.  Other columns and their names do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import first_rows, stored

SHARDS = 8
MOST_NAMES = 1 << 20  # words, or phrases of one length, that are sent to the tasks
WORDS_HELD = 1 << 16  # different words, of all languages, that a task holds before it hands on their counts
CHUNK = 1 << 16  # words of a chunk
KEYS_HELD = 1 << 19  # n-grams, of all shards and languages, that a task holds before it hands on their counts
ROWS_TOLD = 1 << 16  # rows that a task hands on at once
BITS = 31  # of a number
# Fixed by the task: these end a piece, together with the line ends.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_DOT = bytes.maketrans(ENDS, b"." * len(ENDS))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z) and a dot between pieces."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(TO_DOT)
    return raw.replace(b".", b" . ").split()  # of the white space, only spaces and tabs are left


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n; the row without a word has the number of all words of the language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def told():
            while held:
                lang, c = held.popitem()
                words, counts = list(c), np.fromiter(c.values(), dtype=np.int64, count=len(c))
                c.clear()
                for k in range(0, len(words), ROWS_TOLD):
                    yield pd.DataFrame({"lang": lang, "word": words[k : k + ROWS_TOLD], "n": counts[k : k + ROWS_TOLD]})

        size = 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                found = tokens(text)
                c = held.setdefault(lang, Counter())
                size -= len(c)
                c.update(found)
                c[None] += len(found) - c.pop(b".", 0)
                size += len(c)
                if size > WORDS_HELD:
                    yield from told()
                    size = 0
        yield from told()

    found = _texts(docs).mapInPandas(run, "lang string, word binary, n long")
    return found.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, out: str) -> DataFrame:
    """The rows with numbers 0, 1, 2... from the row counts of the partitions."""
    df = stored(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = df.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return df.join(parts, "_part").withColumn(out, number.cast("long")).drop("_at", "_part", "_base")


# ---- texts as numbers ------------------------------------------------------------------


def _chunks(docs: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """shard, lang (the smallest number of a word of the language), n (all words) and words (numbers; -1 breaks)."""
    spark = docs.sparkSession
    langs = words.groupBy("lang").agg(F.min("name").alias("no"))
    if count <= MOST_NAMES:
        known: dict[str, tuple[list[bytes], list[int]]] = {}
        for r in words.select("lang", "word", "name").toLocalIterator():
            w, k = known.setdefault(r.lang, ([], []))
            w.append(r.word.encode("utf-8", "surrogatepass"))
            k.append(r["name"])
        sent = spark.sparkContext.broadcast({lang: (w, np.array(k, dtype=np.int32)) for lang, (w, k) in known.items()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = {lang: dict(zip(w, k.tolist(), strict=True)) for lang, (w, k) in sent.value.items()}
            number = {lang: min(d.values()) for lang, d in names.items()}
            shard = TaskContext.get().partitionId() % SHARDS
            held: dict[int, list] = {}  # language: arrays, their length, all words

            def told(lang):
                arrays, _, n = held.pop(lang)
                return pd.DataFrame({"shard": [shard], "lang": [lang], "n": [n], "words": [np.concatenate(arrays)]})

            for b in batches:
                for lang, text in zip(b["lang"], b["text"], strict=True):
                    if lang not in names:
                        continue
                    found = tokens(text)
                    codes = np.fromiter(map(names[lang].get, found, itertools.repeat(-1)), dtype=np.int32, count=len(found))
                    one_break = (codes >= 0) | np.r_[True, codes[:-1] >= 0] if len(codes) else codes >= 0
                    h = held.setdefault(number[lang], [[], 0, 0])
                    h[0] += [codes[one_break], np.array([-1], dtype=np.int32)]
                    h[1] += len(h[0][-2]) + 1
                    h[2] += len(found) - found.count(b".")
                    if h[1] >= CHUNK:
                        yield told(number[lang])
            for lang in list(held):
                yield told(lang)

        found = _texts(docs).mapInPandas(run, "shard int, lang long, n long, words array<int>")
    else:

        def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shard = TaskContext.get().partitionId() % SHARDS
            for b in batches:
                made = [tokens(t) for t in b["text"]]
                yield pd.DataFrame({"shard": shard, "lang": b["lang"], "n": [len(m) - m.count(b".") for m in made], "told": made})

        spelt = _texts(docs).mapInPandas(spell, "shard int, lang string, n long, told array<binary>")
        spelt = stored(spelt.withColumn("doc", F.monotonically_increasing_id()))
        each = spelt.select("doc", "lang", F.posexplode("told").alias("at", "word")).withColumn("word", F.col("word").cast("string"))
        each = each.join(words.select("lang", "word", "name"), ["lang", "word"], "left")
        codes = each.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", F.lit(-1)).cast("int").alias("k")))).alias("ks"))
        found = spelt.select("doc", "shard", "lang", "n").join(langs, "lang").join(codes, "doc")
        found = found.select("shard", F.col("no").alias("lang"), "n", F.concat("ks.k", F.array(F.lit(-1))).alias("words"))
    return stored(found)


# ---- n-grams ---------------------------------------------------------------------------


def chain(words: np.ndarray, lists: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each length from 1 on, the number of the n-gram that starts at each place, -1 where it is not frequent."""
    names = words
    yield names
    for n, keys in enumerate(lists, start=2):
        nxt = np.full(len(words), -1, dtype=np.int64)
        at, key = grown(words, names, n)
        if len(keys):
            found = np.searchsorted(keys, key)
            found[found == len(keys)] = 0
            hit = keys[found] == key
            nxt[at[hit]] = found[hit]
        names = nxt
        yield names


def grown(words: np.ndarray, names: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of the n-grams of which both (n-1)-grams have a number."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    at = np.flatnonzero((names[:m] >= 0) & (names[1 : m + 1] >= 0))
    return at, (names[at] << BITS) | words[at + n - 1]


def _mined(chunks: DataFrame, sent, n: int) -> DataFrame:
    """shard, lang, key, n: occurrences of n-grams per shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def told():
            while held:
                (shard, lang), arrays = held.popitem()
                keys, counts = np.unique(np.concatenate(arrays), return_counts=True)
                for k in range(0, len(keys), ROWS_TOLD):
                    yield pd.DataFrame({"shard": shard, "lang": lang, "key": keys[k : k + ROWS_TOLD], "n": counts[k : k + ROWS_TOLD]})

        for b in batches:
            for shard, lang, words in zip(b["shard"], b["lang"], b["words"], strict=True):
                words = np.asarray(words, dtype=np.int64)
                *_, names = chain(words, sent.value)
                key = grown(words, names, n)[1]
                held.setdefault((shard, lang), []).append(key)
                size += len(key)
                if size >= KEYS_HELD:
                    yield from told()
                    size = 0
        yield from told()

    return chunks.select("shard", "lang", "words").mapInPandas(run, "shard int, lang long, key long, n long")


def _frequent(chunks: DataFrame, support: DataFrame, longest: int, min_count: int) -> tuple[list[np.ndarray], list[DataFrame]]:
    """For 2, 3... words, as far as they can be sent: the sorted keys of the frequent phrases, and a table key, a of them."""
    sc = chunks.sparkSession.sparkContext
    lists: list[np.ndarray] = []
    tables: list[DataFrame] = []
    part = (F.col("lang") * SHARDS + F.col("shard")).alias("part")
    limits = support.select(part, "least", "unseen")  # a row per shard and language
    for n in range(2, longest + 1):
        # one shuffle by key serves the counts of the shards and those of all
        rows = _mined(chunks, sc.broadcast(lists), n).select("key", part, "n").repartition("key")
        local = rows.groupBy("key", "part").agg(F.sum("n").alias("n")).join(F.broadcast(limits), "part")
        # where a phrase is not frequent it has at most least - 1 occurrences
        seen = F.when(F.col("n") >= F.col("least"), F.col("n") - (F.col("least") - 1))
        # the first filter leaves the candidates, the second those whose counts in all shards, frequent there or not, suffice
        found = local.groupBy("key").agg((F.sum(seen) + F.first("unseen")).alias("most"), F.sum("n").alias("a"))
        exact = stored(found.filter(F.col("most") >= min_count).filter(F.col("a") >= min_count).select("key", "a"))
        count = exact.count()
        if count > MOST_NAMES:
            break
        lists.append(np.sort(np.fromiter((r.key for r in exact.select("key").toLocalIterator()), dtype=np.int64, count=count)))
        tables.append(exact)
        if not count:
            lists += [lists[-1]] * (longest - n)
            break
    return lists, tables


def _spelt(spark, lists: list[np.ndarray], tables: list[DataFrame]) -> DataFrame:
    """words (numbers), a of the phrases whose keys the tables hold."""
    sent = spark.sparkContext.broadcast(lists)
    mask = (1 << BITS) - 1

    def spell(k: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                key, words = b["key"].to_numpy(), []
                for keys in reversed(sent.value[:k]):
                    words.append(key & mask)
                    key = keys[key >> BITS]
                words = np.stack([key >> BITS, key & mask, *words[::-1]], axis=1)
                yield pd.DataFrame({"words": list(words), "a": b["a"].to_numpy()})

        return run

    out = spark.createDataFrame([], "words array<long>, a long")
    for k, table in enumerate(tables):
        out = out.union(table.mapInPandas(spell(k), "words array<long>, a long"))
    return out


def _plain(chunks: DataFrame, n: int, least: int) -> DataFrame:
    """words, a of the frequent n-grams, counted as arrays."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.slice("words", i, n)))
    found = chunks.filter(F.size("words") >= n).select(gram.alias("words")).filter(~F.array_contains("words", -1))
    return found.groupBy("words").agg(F.count("*").alias("a")).filter(F.col("a") >= least).select(F.col("words").cast("array<long>").alias("words"), "a")


# ---- phrases ---------------------------------------------------------------------------


def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Phrases (lang, words, phrase, a) of 1 to ``longest`` words with at least ``min_count`` occurrences; lang, n of the languages."""
    counts = stored(word_counts(docs).filter((F.col("n") >= min_count) | F.col("word").isNull()))
    langs = counts.filter("word IS NULL").select("lang", "n")
    words = stored(numbered(counts.filter("word IS NOT NULL"), "name"))
    chunks = _chunks(docs, words, words.count())
    total = words.groupBy("lang").agg(F.min("name").alias("no")).join(langs, "lang").select(F.col("no").alias("lang"), F.col("n").alias("all"))
    share = chunks.groupBy("shard", "lang").agg(F.sum("n").alias("own")).join(total, "lang")
    least = F.ceil(F.lit(min_count).cast("decimal(20,0)") * F.col("own") / F.col("all")).cast("long")
    share = share.select("shard", "lang", F.greatest(least, F.lit(1)).alias("least"))
    unseen = share.groupBy("lang").agg(F.sum(F.col("least") - 1).alias("unseen"))
    support = stored(share.join(unseen, "lang"))
    lists, tables = _frequent(chunks, support, longest, min_count)
    found = _spelt(docs.sparkSession, lists, tables)
    for n in range(len(lists) + 2, longest + 1):
        found = found.union(_plain(chunks, n, min_count))
    found = stored(found)
    each = found.select("a", F.col("words").alias("ks"), F.posexplode("words").alias("at", "name")).join(words.select("name", "lang", "word"), "name")
    told = each.groupBy("ks").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    told = told.select("lang", F.col("ws.word").alias("words"), "a")
    single = words.select("lang", F.array("word").alias("words"), F.col("n").alias("a"))
    return told.union(single).withColumn("phrase", F.array_join("words", " ")), langs


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of every language whose words attract each other most."""
    phrases, langs = frequent_phrases(docs, min_count, longest)
    phrases = stored(phrases)
    count = phrases.select("lang", "phrase", "a")
    part = lambda first, length: F.array_join(F.slice("words", first, length), " ")
    size = F.size("words")
    cuts = phrases.filter(size > 1).withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("one"), part(F.col("k") + 1, size - F.col("k")).alias("two"))
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("one"), F.col("a").alias("l")), ["lang", "one"])
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("two"), F.col("a").alias("r")), ["lang", "two"]).join(langs, "lang")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("top", F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(16,0)")).withColumn("low", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("top div low"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    longer = phrases.filter(size > 2).select("lang", "a", F.explode(F.array(part(F.lit(1), size - 1), part(F.lit(2), size - 1))).alias("phrase"))
    best = best.join(longer, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = first_rows(best, ["lang"], order, top, F.xxhash64("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return best.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")
