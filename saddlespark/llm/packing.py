"""Best-fit-decreasing packing of token sequences into windows of a fixed size.

Documents are tokenized and cut into pieces: full windows as long as they last, then the
rest.  Pieces are dealt into groups of bounded size by a hash of their document, content and
place in the input, so that repeated rows spread as well; in each group they are placed
longest first, each into the open window with the least room that still holds it.  A segment
tree over remaining capacities finds that window in a dozen steps.  Windows never span groups,
so groups are independent tasks and a lost one is simply redone; the padding that separate
groups cost is a fraction of a window per group.

Only lengths, not ids, are moved for the placement (``pack``).  ``sequences`` moves the ids as
well and returns the padded windows themselves.

Cases: a null or empty text gives one piece that holds the closing id alone.  Repeated rows and
repeated doc_ids are separate pieces.  Ties in length go by doc_id, start and content, so
reruns over the same files and splits agree.  Very long texts are cut, never shortened.  Further columns of the documents are
left out (``pieces`` names its columns).  An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
GROUP_PIECES = 8192  # pieces that one task places
WORDS_KEPT = 1_000_000  # words whose ids a worker remembers, some 200 bytes each
TEXTS_AT_ONCE = 1024  # whose words are looked up together

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _WordIds(dict):
    """Ids of words as little-endian bytes.

    Words are learnt many at a time: one by one the calls cost more than the encoding.  Words of
    letters only are one stretch for the tokenizer and end in a token that closes a word; other
    words are told apart by a mark between them.
    """

    MARK = "\ue000"
    TAILS = frozenset(".,;:!?")

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spelt = [i.to_bytes(4, "little") for i in range(max(vocabulary.values()) + 1)]
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = self._encode(self.MARK)

    def _encode(self, text: str):
        import numpy as np

        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _lettered(self, words: list[str]) -> None:
        """Words of lower-case ASCII letters, which the normalizer and the patterns leave as they are."""
        merged, spelt = self.tokenizer.model.tokenize, self.spelt
        self.update([(w, b"".join([spelt[t.id] for t in merged(w)])) for w in words])

    def _plain(self, words: list[str]) -> list:
        import numpy as np

        ids = self._encode(" ".join(words))
        ends = np.flatnonzero(self.closes[ids]) + 1
        return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) == len(words) and ends[-1] == len(ids) else []

    def _marked(self, words: list[str]) -> list:
        import numpy as np

        ids, n = self._encode(f" {self.MARK} ".join(words)), len(self.mark)
        hit = np.ones(max(0, len(ids) - n + 1), dtype=bool)
        for k in range(n):
            hit &= ids[k : len(ids) - n + 1 + k] == self.mark[k]
        at = np.flatnonzero(hit)
        if len(at) != len(words) - 1 or self.MARK in "".join(words):
            return []
        return [ids[s:e] for s, e in zip([0, *(at + n)], [*at, len(ids)], strict=True)]

    def _add(self, words: list[str], cut) -> None:
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            found = cut(part) or [self._encode(w) for w in part]
            self.update((w, x.tobytes()) for w, x in zip(part, found, strict=True))

    def learn(self, words: set[str]) -> None:
        """Ids for words not known yet.

        A mark behind a letter is a token of its own, and ASCII letters are lowered by the
        tokenizer itself, so such words are put together from others.  Words with other
        characters are not lowered here, as names of special tokens are told apart by case.
        """
        if len(self) > WORDS_KEPT:
            self.clear()
            self[""] = b""
        parts, need = [], set(self.TAILS)
        for w in words.difference(self):
            base, tail = (w[:-1], w[-1]) if w[-1] in self.TAILS and w[-2:-1].isalpha() else (w, "")
            if base.isascii() and base.isalpha():
                base = base.lower()
            need.add(base)
            if base != w:
                parts.append((w, base, tail))
        need.difference_update(self)
        letters = [w for w in need if w.isalpha()]
        self._lettered([w for w in letters if w.isascii()])
        self._add([w for w in letters if not w.isascii()], self._plain)
        self._add([w for w in need if not w.isalpha()], self._marked)
        self.update((w, self[base] + self[tail]) for w, base, tail in parts)


def stretches(text: str | None) -> list[str]:
    """A text cut at blanks and line ends.

    The tokenizer drops white space and no token spans it, so the stretches can be encoded one
    by one; words come again, whole texts do not.
    """
    text = text or ""
    if text.isascii() and "<|" not in text:
        text = text.lower()  # as the tokenizer does, so that fewer stretches differ; it tells names of special tokens apart by case
    return text.replace("\n", " ").split(" ")


def token_bytes(texts: list[str | None], ids: _WordIds) -> Iterator[bytes]:
    """Ids of each text and the closing id, four bytes each."""
    for k in range(0, len(texts), TEXTS_AT_ONCE):
        words = [stretches(t) for t in texts[k : k + TEXTS_AT_ONCE]]
        ids.learn(set().union(*words))
        for w in words:
            yield b"".join(map(ids.__getitem__, w)) + END_ID.to_bytes(4, "little")


def cut(buffer: bytes, window: int) -> list[tuple[int, bytes]]:
    """Full windows from the front, then the rest: (first token, bytes)."""
    return [(at // 4, buffer[at : at + 4 * window]) for at in range(0, len(buffer), 4 * window)]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenize ``docs`` (doc_id, text) and cut them; ``with_ids`` adds the ids as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _WordIds(tokenizer)
        for batch in batches:
            rows = []
            texts = [t if isinstance(t, str) else None for t in batch["text"]]
            for doc, buffer in zip(batch["doc_id"].array, token_bytes(texts, ids), strict=True):
                for start, part in cut(buffer, window):
                    row = (doc, start, len(part) // 4, zlib.crc32(part), len(buffer) // 4)
                    rows.append((*row, part) if with_ids else row)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return light.mapInPandas(run, PIECE + (", ids binary" if with_ids else ""))


class Rooms:
    """Open windows by remaining room: a segment tree over 1..window tells the tightest fit."""

    def __init__(self, window: int):
        self.base = 1
        while self.base <= window:
            self.base *= 2
        self.count = [0] * (2 * self.base)  # open windows below each node
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.open.setdefault(room, []).append(window)
        node = self.base + room
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, least: int) -> tuple[int, int] | None:
        """The room and number of a window with the smallest room of at least ``least``."""
        node = self.base + least
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.base
        window = self.open[room].pop()
        while node:
            self.count[node] -= 1
            node //= 2
        return room, window


def place(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """Window number and offset for lengths that come in falling order."""
    rooms, out, opened = Rooms(window), [], 0
    for n in lengths:
        found = rooms.take(n)
        room, at = found if found else (window, opened)
        opened += not found
        out.append((at, window - room))
        if room > n:
            rooms.add(room - n, at)
    return out


def _groups(docs: DataFrame, window: int) -> int:
    """How many groups keep each near ``GROUP_PIECES`` pieces; a token has at least one byte of text."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) / F.lit(4 * window)
    total = docs.agg(F.sum(F.lit(1.0) + F.floor(size)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // GROUP_PIECES))


def pack(parts: DataFrame, groups: int | Column, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (any columns besides PIECE come along)."""
    schema = parts.schema.simpleString()[7:-1]

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop(columns="_group").sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable"
        )
        spots = place(group["length"].tolist(), window)
        base = int(key[0]) << 32
        group["sequence_id"] = [base + s for s, _ in spots]
        group["offset"] = [o for _, o in spots]
        return group

    # the place of a row in its input split tells repeated rows apart, and is the same when a lost task is redone
    place_in_split = F.monotonically_increasing_id()
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", place_in_split), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Where each piece of each document goes."""
    return pack(pieces(docs, tokenizer, window), _groups(docs, window), window)


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The windows themselves: ``sequence_id``, ``ids`` (always ``window`` long) and ``n_tokens`` before padding."""
    placed = pack(pieces(docs, tokenizer, window, with_ids=True), _groups(docs, window), window)
    rows = placed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out = []
            for parts in batch["parts"]:
                ids = np.full(window, pad_id, dtype="<u4")
                filled = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4")
                ids[: len(filled)] = filled
                out.append(ids.astype("int32"))
            yield pd.DataFrame({"sequence_id": batch["sequence_id"], "ids": out, "n_tokens": batch["n_tokens"]})

    return rows.mapInPandas(run, "sequence_id long, ids array<int>, n_tokens long")
