"""Alignment of the tokens of two tokenizers, and how often their tokens stand for each other.

A text, after a space, is encoded by a byte-level BPE (A) and a piece BPE with byte fallback (B).  Both give
arrays of end offsets in bytes.  Where both have the same end, a group of tokens is complete on both sides.

*Diagonal run skipping.*  While groups hold one token on each side, ends at i and i + shift agree.
Such stretches are jumped: blocks of 1, 2, 4... ends are compared at the present shift, and the last block
that differs is halved to its first difference.  There an irregular group begins; its
end is found by advancing whichever side lies behind, and the shift is set anew.

*Links.*  A token of A and one of B are linked if their byte ranges overlap.  Cutting a text at all ends of both sides gives
one interval for each link.

*Counts.*  Texts are taken in blocks of about ``BLOCK_LINKS`` different links.  A block has a list of its
pairs of ids with the number of its texts that hold them, and texts refer to places of that
list.  Only these lists are added up over the corpus and joined back; a second join, by
block, brings each text together with its block's list.  So the shuffles carry one row per
block and pair, and one per text.

Encoding goes by segments: a text is cut before each space that follows a character other than
white space.  No pre-token of A crosses such a place, and no piece of B has a space behind
another character (checked when the pieces are loaded), so segments encode as they do in the text.  Segments are
remembered, up to a bound.

Cases: texts that are null, empty, or whose joined tokens differ from the text after its
space (a literal U+2581 becomes a space in B) have no tokens; all numbers are 0, lists and the
digest empty.  Repeated rows and texts under one doc_id are texts of their own and count each.  Ties for the
highest count of an id are all best.  Long texts are used whole.  Other columns do not matter;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder

# Fixed by the vocabulary A: how it cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S)(?= )")
SPACE = "▁"  # stands for a space in the pieces of B
MEMORY = 200_000  # segments that a worker remembers
MEMORY_TOKENS = 2_000_000
BATCH_CHARS = 1 << 21  # of texts that are encoded at once; one text at least
BLOCK_LINKS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabularies:
    """Both tokenizers, and how many bytes each of their tokens stands for."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        alphabet = byte_alphabet()
        with open(a_path, encoding="utf-8") as f:
            told = json.load(f)
        special = {t["content"] for t in told["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in t): k for t, k in told["model"]["vocab"].items() if t not in special}
        self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.a_bytes[k] = t
        self.a_len = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece goes on behind a space: texts cannot be cut at spaces")
        self.encode_b = b.encode
        self.space = b.piece_to_id(SPACE)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.b_len = np.array([len(t) for t in self.b_bytes], dtype=np.int64)


class Segments(dict):
    """Number of each segment met; its tokens of both kinds in long arrays."""

    def __init__(self, vocabularies: Vocabularies):
        super().__init__()
        self.v = vocabularies
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._new: list[str] = []
        none = np.empty(0, dtype=np.int64)
        self.a, self.b, self.a_at, self.b_at = none, none, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.sound = np.empty(0, dtype=bool)

    def __missing__(self, segment: str) -> int:
        out = self[segment] = len(self.sound) + len(self._new)
        self._new.append(segment)
        return out

    def _encode(self, text: str) -> tuple[list[int], list[int], bool]:
        a = self.v.encode_a(text)
        b = self.v.encode_b(text[1:]) if len(text) > 1 else [self.v.space]
        raw = text.encode()
        return a, b, b"".join([self.v.a_bytes[k] for k in a]) == raw == b"".join([self.v.b_bytes[k] for k in b])

    def settle(self) -> None:
        """Encode the segments met since the last call: together if they can stand behind each other, else one by one."""
        new, self._new = self._new, []
        if not new:
            return
        chainable = [k for k, s in enumerate(new) if not s[-1].isspace()]
        sizes = np.zeros((2, len(new)), dtype=np.int64)
        sound = np.ones(len(new), dtype=bool)
        parts: list[tuple[np.ndarray, np.ndarray]] = [None] * len(new)  # type: ignore[list-item]
        a, b, fits = self._encode("".join([new[k] for k in chainable])) if chainable else ([], [], True)
        rest = range(len(new))
        if fits and chainable:
            a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
            ends = np.cumsum([len(new[k].encode()) for k in chainable])
            cuts = [np.searchsorted(np.cumsum(size[ids]), ends, side="right") for ids, size in ((a, self.v.a_len), (b, self.v.b_len))]
            starts = [np.r_[0, c[:-1]] for c in cuts]
            for n, k in enumerate(chainable):
                parts[k] = (a[starts[0][n] : cuts[0][n]], b[starts[1][n] : cuts[1][n]])
            rest = sorted(set(rest) - set(chainable))
        for k in rest:
            one, two, sound[k] = self._encode(new[k])
            parts[k] = (np.array(one, dtype=np.int64), np.array(two, dtype=np.int64))
        sizes[0], sizes[1] = [len(p) for p, _ in parts], [len(p) for _, p in parts]
        self.a, self.b = np.concatenate([self.a, *[p for p, _ in parts]]), np.concatenate([self.b, *[p for _, p in parts]])
        self.a_at = np.concatenate([self.a_at, self.a_at[-1] + np.cumsum(sizes[0])])
        self.b_at = np.concatenate([self.b_at, self.b_at[-1] + np.cumsum(sizes[1])])
        self.sound = np.concatenate([self.sound, sound])

    def shrink(self) -> None:
        if len(self) > MEMORY or len(self.a) + len(self.b) > MEMORY_TOKENS:
            self._reset()


def gathered(values: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``wanted`` of an array, one behind the other, and their lengths."""
    sizes = at[wanted + 1] - at[wanted]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(at[wanted] - (ends - sizes), sizes) + np.arange(total)], sizes


def common_ends(ea: list[int], eb: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in both arrays of ends where groups end; the arrays end alike."""
    i = j = start_i = start_j = 0
    n = len(ea)
    runs: list[tuple[int, int, int]] = []
    while i < n:
        step = 1
        while i + step <= n and ea[i : i + step] == eb[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        while step > 1:
            step //= 2
            if i + step <= n and ea[i : i + step] == eb[j : j + step]:
                i, j = i + step, j + step
        if i > start_i:
            runs.append((start_i, start_j, i - start_i))
        if i == n:
            break
        a, b = ea[i], eb[j]
        while a != b:
            if a < b:
                i += 1
                a = ea[i]
            else:
                j += 1
                b = eb[j]
        start_i, start_j, i, j = i, j, i + 1, j + 1
        if i == n:
            runs.append((start_i, start_j, 1))
    if not runs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    si, sj, length = np.array(runs, dtype=np.int64).T
    along = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    return np.repeat(si, length) + along, np.repeat(sj, length) + along


class Aligned:
    """Tokens and groups of some texts, one text behind the other.

    ``a``, ``b`` are ids, ``ga``, ``gb`` the places of the last tokens of the groups; ``a_of``,
    ``b_of``, ``g_of`` say where each text starts in them (one entry more than texts).
    """

    def __init__(self, known: Segments, texts: list[str | None]):
        v = known.v
        numbers = [list(map(known.__getitem__, CUT.split(" " + t))) if t else [] for t in texts]
        known.settle()
        lengths = np.array([len(x) for x in numbers], dtype=np.int64)
        flat = np.fromiter((k for x in numbers for k in x), dtype=np.int64, count=int(lengths.sum()))
        text = np.repeat(np.arange(len(texts)), lengths)
        wrong = np.zeros(len(texts), dtype=bool)
        wrong[text[~known.sound[flat]]] = True
        flat, text = flat[~wrong[text]], text[~wrong[text]]
        self.a, a_sizes = gathered(known.a, known.a_at, flat)
        self.b, b_sizes = gathered(known.b, known.b_at, flat)
        per_text = lambda sizes: np.r_[0, np.cumsum(np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64))]
        self.a_of, self.b_of = per_text(a_sizes), per_text(b_sizes)
        self.ea, self.eb = np.cumsum(v.a_len[self.a]), np.cumsum(v.b_len[self.b])
        self.ga, self.gb = common_ends(self.ea.tolist(), self.eb.tolist())
        self.g_of = np.searchsorted(self.ga, self.a_of)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and ids of every pair of overlapping tokens."""
        ends = np.sort(np.concatenate([self.ea, self.eb]), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        i, j = np.searchsorted(self.ea, ends), np.searchsorted(self.eb, ends)
        return np.searchsorted(self.a_of, i, side="right") - 1, self.a[i], self.b[j]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each group on both sides."""
        return np.diff(self.ga, prepend=-1), np.diff(self.gb, prepend=-1)

    def written(self, table: np.ndarray, ids: int) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for every text."""
        sa, sb = self.sizes()
        mark_a, mark_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        mark_a[self.ga], mark_b[self.gb] = ids, 2 * ids
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + np.repeat(self.gb + 1 - sb, sa)] = self.a + mark_a
        order[np.arange(len(self.b)) + np.repeat(self.ga + 1, sb)] = self.b + mark_b
        told = table[order]
        of = self.a_of + self.b_of
        return [told[s:e].tobytes().replace(b"\0", b"")[:-1] for s, e in zip(of[:-1], of[1:], strict=True)]


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Few texts at a time, by their length."""
    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text")
        start = held = 0
        found: list[str | None] = []
        for k in range(len(texts)):
            found.append(texts[k].as_py())
            held += len(found[-1] or "")
            if held >= BATCH_CHARS or k == len(texts) - 1:
                yield ids.slice(start, k + 1 - start), found
                start, held, found = k + 1, 0, []


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids and, group by group, how many tokens of each it has (a_sizes, b_sizes)."""
    names = ("a_ids", "b_ids", "a_sizes", "b_sizes")
    schema = pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int32())) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Segments(Vocabularies(a_path, b_path))
        for ids, texts in _batches(batches):
            x = Aligned(known, texts)
            sa, sb = x.sizes()
            lists = [_lists(v, of) for v, of in ((x.a, x.a_of), (x.b, x.b_of), (sa, x.g_of), (sb, x.g_of))]
            yield pa.RecordBatch.from_arrays([ids, *lists], schema=schema)
            known.shrink()

    return _ids(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} array<int>" for n in names))


def _lists(values: np.ndarray, of: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of texts (block, doc_id, n_a ... groups_sha256, at, times) and of blocks (block, pairs, texts)."""
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    numbers = ("n_a", "n_b", "n_groups", "n_links")
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in numbers], ("groups_sha256", pa.string())]
        + [("at", ints), ("times", ints), ("pairs", longs), ("texts", ints)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabularies(a_path, b_path)
        known, many = Segments(v), max(len(v.a_bytes), len(v.b_bytes))
        table = np.array([f"{k}{c}".encode() for c in ",|;" for k in range(many)])
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple[pa.Array, list[np.ndarray], list[str]]] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # text in the block, pair, times
        count = links = 0

        def told() -> Iterator[pa.RecordBatch]:
            text, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
            pairs, at = np.unique(pair, return_inverse=True)
            of = np.r_[0, np.cumsum(np.bincount(text, minlength=count))]
            ids = pa.concat_arrays([r[0] for r in rows])
            figures = [pa.array(np.concatenate([r[1][k] for r in rows])) for k in range(len(numbers))]
            digests = pa.array([d for r in rows for d in r[2]], pa.string())
            where = pa.array(np.full(count, block))
            yield pa.RecordBatch.from_arrays(
                [where, ids, *figures, digests, _lists(at, of), _lists(times, of), pa.nulls(count, longs), pa.nulls(count, ints)], schema=schema
            )
            lists = [pa.array([pairs], longs), pa.array([np.bincount(at, minlength=len(pairs)).astype(np.int32)], ints)]
            yield pa.RecordBatch.from_arrays([where[:1], *[pa.nulls(1, schema.field(k).type) for k in range(1, 9)], *lists], schema=schema)

        for ids, texts in _batches(batches):
            x = Aligned(known, texts)
            text, a, b = x.links()
            key, times = np.unique((text << 40) | (a * len(v.b_bytes) + b), return_counts=True)
            held.append(((key >> 40) + count, key & ((1 << 40) - 1), times))
            figures = [np.diff(x.a_of), np.diff(x.b_of), np.diff(x.g_of), np.bincount(text, minlength=len(texts))]
            rows.append((ids, figures, [hashlib.sha256(w).hexdigest() if w else "" for w in x.written(table, many)]))
            known.shrink()
            count, links = count + len(texts), links + len(key)
            if links >= BLOCK_LINKS:
                yield from told()
                rows, held, count, links, block = [], [], 0, 0, block + 1
        if count:
            yield from told()

    lists = "at array<int>, times array<int>, pairs array<long>, texts array<int>"
    found = _ids(docs).mapInArrow(run, f"block long, doc_id long, {', '.join(f'{n} long' for n in numbers)}, groups_sha256 string, {lists}")
    path = f"{shared_folder(docs.sparkSession)}/alignments-{uuid.uuid4().hex}"
    found.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pair_counts(stored: DataFrame, b_ids: int) -> tuple[DataFrame, DataFrame]:
    """block, place, pair, texts of the lists of blocks; and pair, count (texts that hold it), best (highest of its A id)."""
    pairs = stored.filter("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "texts")).alias("place", "p"))
    pairs = pairs.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.texts").alias("texts"))
    total = pairs.groupBy("pair").agg(F.sum("texts").alias("count")).withColumn("a", F.expr(f"pair div {b_ids}"))
    most = total.groupBy("a").agg(F.max("count").alias("most"))
    return pairs, total.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_statistics(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every text."""
    import sentencepiece

    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    stored = _blocks(docs, a_path, b_path)
    pairs, known = pair_counts(stored, b_ids)
    told = pairs.select("block", "place", "pair").join(known, "pair").select(F.col("block").alias("of"), "place", "count", "best")
    texts = stored.filter("pairs IS NULL").drop("pairs", "texts")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(right), dtype=np.int64), np.zeros(len(right), dtype=bool)
        count[right["place"]], best[right["place"]] = right["count"], right["best"]
        sums, bests = [], []
        for at, times in zip(left["at"], left["times"], strict=True):
            times = times.astype(np.int64)
            sums.append(int((count[at] * times).sum()))
            bests.append(int(times[best[at]].sum()))
        return left.drop(columns=["block", "at", "times"]).assign(n_best=bests, count_sum=sums)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("block").cogroup(told.groupBy("of")).applyInPandas(run, schema)
