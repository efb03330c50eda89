"""Alignment of two tokenizers against whole-text encoding and a plain loop over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from saddlespark.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = ta.byte_alphabet()

    def tokens(text):
        if not text:
            return [], []
        one = [(k, bytes(alphabet[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in b.encode(text)]
        raw = (" " + text).encode()
        if b"".join(t for _, t in one) != raw or b"".join(t for _, t in two) != raw:
            return [], []
        return one, two

    return tokens


def spans(tokens):
    out, at = [], 0
    for k, t in tokens:
        out.append((k, at, at + len(t)))
        at += len(t)
    return out


def want(rows, plain):
    each = []
    for doc_id, text in rows:
        a, b = (spans(t) for t in plain(text))
        common = {e for _, _, e in a} & {e for _, _, e in b}
        groups = [([], []) for _ in common]
        for side, x in enumerate((a, b)):
            n = 0
            for k, _, e in x:
                groups[n][side].append(k)
                n += e in common
        links = []
        j = 0
        for k, f, t in a:
            while j and b[j - 1][2] > f:
                j -= 1
            while j < len(b) and b[j][1] < t:
                if b[j][2] > f:
                    links.append((k, b[j][0]))
                j += 1
        each.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(p for *_, links in each for p in set(links))
    best = defaultdict(int)
    for (k, _), n in counts.items():
        best[k] = max(best[k], n)
    out = []
    for doc_id, na, nb, groups, links in each:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if told else ""
        out.append((doc_id, na, nb, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def texts(rng):
    words = ["the", "Thingwhent", "of", "naïve", "日本語のテキスト", "don't", "we'll", "1234", "3.14", "<|endoftext|>", "</s>", "<s>", "<unk>", "<0x0A>"]
    words += ["▁", "a▁b", "é" * 3, "\x00", "\x85", "　", "🙂👍🏽", "x" * 70, "\t", "\r\n", "\n\n", "...", "$%&", "​", "﻿", "ﬁ", "\x1c"]
    fixed = [None, "", " ", "  ", "\n", "a ", "a  ", " a", "   a", "a \n", "a\n b", "a \n\n  b", "▁", " ▁", "no" * 500, "日本" * 300, " " * 300, "\n" * 50]
    made = []
    for _ in range(120):
        made.append("".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "  ", "\n", "", "\n \n", "   ", ", "]) for _ in range(rng.randrange(1, 60))))
    plain_words = [w for w in words if "▁" not in w]
    return fixed + made + [" ".join(rng.choice(plain_words) for _ in range(5_000))]


@pytest.mark.parametrize("chars, links, memory", [(1 << 21, 2_000_000, 200_000), (500, 900, 20)])
def test_statistics_as_by_loops(spark, monkeypatch, plain, chars, links, memory):
    for name, x in (("BATCH_CHARS", chars), ("BLOCK_LINKS", links), ("MEMORY", memory)):
        monkeypatch.setattr(ta, name, x)
    rng = random.Random(links)
    rows = [(i, t) for i, t in enumerate(texts(rng))]
    rows += rows[20:30] + [(None, "the end of it"), (20, "another text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ta.alignment_statistics(df, A, B).select(*NAMES).collect()), key=repr)
    assert got == want(rows, plain)


def test_groups_can_be_read_back(spark, plain):
    rows = [(i, t) for i, t in enumerate(texts(random.Random(5)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in ta.align(df, A, B).collect():
        a, b = plain(rows[r.doc_id][1])
        assert (r.a_ids, r.b_ids) == ([k for k, _ in a], [k for k, _ in b])
        assert sum(r.a_sizes) == len(a) and sum(r.b_sizes) == len(b) and len(r.a_sizes) == len(r.b_sizes)
        i = j = 0
        for m, n in zip(r.a_sizes, r.b_sizes, strict=True):
            assert b"".join(t for _, t in a[i : i + m]) == b"".join(t for _, t in b[j : j + n])
            i, j = i + m, j + n


def test_runs_are_found_at_every_shift():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(1, 200)
        ends = [sorted(rng.sample(range(1, n), int(rng.random() ** 0.3 * (n - 1)))) + [n] for _ in range(2)]
        ga, gb = ta.common_ends(*ends)
        assert [ends[0][k] for k in ga] == [ends[1][k] for k in gb] == sorted(set(ends[0]) & set(ends[1]))
    assert [len(x) for x in ta.common_ends([], [])] == [0, 0]


def test_empty_table_and_further_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ta.alignment_statistics(df, A, B).count() == 0 and ta.align(df, A, B).count() == 0
    df = spark.createDataFrame([(1, "one text", 5, "x")], "doc_id long, text string, block long, `at.x` string")
    assert ta.alignment_statistics(df, A, B).count() == 1
