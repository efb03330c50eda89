"""Removal of repeated and nearly repeated lines across a corpus.

Lines are normalised (lower case, marks at the ends of words dropped; digits stay, so rows of
numbers are copies only if the numbers are).  Equal normalised lines are one class from the
start.  Different ones are linked if their edit
similarity reaches ``SIMILARITY``; of every connected group the first occurrence (by doc_id,
then line) stays.

Which lines are compared is decided by fingerprints of their words.  A line has ``BANDS`` keys,
each made of ``ROWS`` minima over hashes of its words (weighted MinHash), short lines more; lines
that share a key meet.  Blocks of SimHash bits do not find enough: the README has the figures.  Each list of
a key is scanned with everybody against the list's smallest member, then, where members are still
apart, against another one; that connects groups of near copies without forming their pairs.  Last
come the pairs of different components inside the lists, in blocks of bounded size.  Lengths that rule the similarity out,
and SimHash fingerprints that differ in more than ``DISTANCE`` of 64 bits, stop a
pair; so do counts of two-character sequences that differ by more than the edit similarity
allows.  The edit distance of the others is compared with the bound.

Words weigh by length, so lines do not meet for their small words.  Keys are a matter of chance:
a pair that shares no key and no third line is missed; the README has the measured recall.

Cases: lines with fewer than ``MIN_WORDS`` words always stay.  Null texts stay null, empty ones
empty.  Rows that repeat doc_id and text count as one document and come out alike.  Ties in
doc_id go by a hash of the text.  Long lines and texts are used whole.  Further columns come
along unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored
from .components import components, merged
from .edits import bounded
from .lists import alike_across

MIN_WORDS = 5
SIMILARITY = 0.8
# Bits in which fingerprints of compared lines may differ; of unlike lines about one in thirty differs in so few.
DISTANCE = 24
BANDS = 8
ROWS = 3
# Lines of up to so many words, of which one changed word is a larger part, have further keys of fewer minima.
SHORT = 16
SHORT_BANDS = 12
SHORT_ROWS = 2
TURNS = 1  # more scans of lists with another member, before pairs are formed
WORDS_KEPT = 200_000  # words that a worker remembers, 232 bytes each in the tables of votes and ranks
ROWS_HELD = 1 << 8
HELD_WORDS = 1 << 17  # words of lines that wait for their fingerprints
CHUNK_WORDS = 1 << 13  # words whose bits are summed at once
# Votes are summed in lanes of 16 bits, four to a number: SEGMENT words of HEAVIEST fit.
LANES = 16
HEAVIEST = 127
SEGMENT = 512
TABLES = [(np.uint64,), (np.uint64, LANES + 1), (np.uint32, BANDS * ROWS), (np.int64,)]
ENDS = [(f"{mark}{space}", space) for mark in ",." for space in " \n"]  # the commonest marks at ends of words
LOOK, LOOKS = 64, 16  # columns of an edit distance after which one is written out: at least, and a share of the line
PAIR_COUNTS = 1024  # counters of two-character sequences in a line
COUNTED = 1 << 9  # lines whose sequences are counted at once
STRIPPED = 192  # characters of a line from which on words that a pair has in common are looked for
BROADCAST_IDS = 1 << 20  # line numbers of 4 bytes; more go through a shuffled join

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = string.punctuation


def normal_word(word: str) -> str:
    word = word.lower()
    # most words begin and end with a letter or digit, or do without plain marks
    if not (word[0].isalnum() and word[-1].isalnum()):
        word = word.strip(MARKS)
        if word and not (word[0].isalnum() and word[-1].isalnum()):
            return EDGES.sub("", word)
    return word


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)  # the mixing constant of splitmix64
    return x ^ (x >> np.uint64(29))


class Words(dict):
    """Number of each word as it stands in a line.

    By number, once they are settled: ``hashes`` has the normalised words' hashes, ``votes`` what
    each word adds to every bit of a fingerprint, its weight where its hash has the bit, four bits
    to a column, and the weight in the last column.
    ``ranks`` has its place in each of the orders whose first words make the keys, ``sizes`` its
    length, 0 for mere marks.
    """

    def __init__(self):
        import xxhash

        super().__init__()
        self.hash = xxhash.xxh64_intdigest
        self.salts = [np.uint64(self.hash(bytes([k])) | 1) for k in range(BANDS * ROWS)]
        self._space = [np.empty((1 << 12, *shape), dtype=kind) for kind, *shape in TABLES]
        self._show(0)

    def _show(self, count: int) -> None:
        self.hashes, self.votes, self.ranks, self.sizes = (x[:count] for x in self._space)

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out

    def settle(self) -> None:
        """Extend the tables by the words met since the last call."""
        if len(self.hashes) < len(self):
            found = [*map(normal_word, itertools.islice(self, len(self.hashes), None))]
            hashes = np.array([*map(self.hash, found)], dtype=np.uint64)
            sizes = np.array([*map(len, found)], dtype=np.int64)
            weights = np.clip(sizes - 2, 1, HEAVIEST).astype(np.uint16)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ranks = np.empty((BANDS * ROWS, len(hashes)), dtype=np.uint32)
            for k, salt in enumerate(self.salts):
                # a quotient, not a logarithm: it has the same bits on every machine
                np.floor_divide((mixed(hashes * salt) >> np.uint64(32)).astype(np.uint32), weights, out=ranks[k])
            old = len(self.hashes)
            if len(self) > len(self._space[0]):
                for k, x in enumerate(self._space):
                    self._space[k] = np.empty((2 * len(self), *x.shape[1:]), dtype=x.dtype)
                    self._space[k][:old] = x[:old]
            self._show(len(self))
            self.hashes[old:], self.ranks[old:], self.sizes[old:] = hashes, ranks.T, sizes
            self.votes[old:, :LANES], self.votes[old:, LANES] = (bits * weights[:, None]).view(np.uint64), weights

    def shrink(self) -> None:
        if len(self) >= WORDS_KEPT:
            self.clear()
            self._show(0)


def _chunks(starts: np.ndarray, total: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs of lines with few words: first line and the one after the last, first word and the one after the last."""
    ends = np.r_[starts[1:], total]
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_WORDS, side="right")))
        yield at, upto, starts[at], ends[upto - 1]
        at = upto


def fingerprints(votes: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SimHash of lines: per bit, whether words with more than half of the weight have it, from each start to the next."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for at, upto, lo, hi in _chunks(starts, len(words)):
        first = starts[at:upto] - lo
        # long lines are summed in segments, which no lane can overflow
        parts = -(-np.diff(np.r_[first, hi - lo]) // SEGMENT)
        base = np.cumsum(parts) - parts
        segments = np.repeat(first, parts) + (np.arange(parts.sum()) - np.repeat(base, parts)) * SEGMENT
        sums = np.add.reduceat(votes[words[lo:hi]], segments, axis=0)
        heavy, total = np.ascontiguousarray(sums[:, :LANES]).view(np.uint16).astype(np.uint32), sums[:, LANES]
        if len(parts) < len(segments):
            heavy, total = np.add.reduceat(heavy.astype(np.uint64), base, axis=0), np.add.reduceat(total, base)
        out[at:upto] = np.packbits(heavy * heavy.dtype.type(2) > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _keys(least: np.ndarray, first: int) -> np.ndarray:
    """A number per band from its minima (line, band, row); bands are told apart by numbers from ``first`` on."""
    key = np.broadcast_to(np.arange(first, first + least.shape[1], dtype=np.uint64), least.shape[:2])
    for k in range(least.shape[2]):
        key = mixed((key ^ least[:, :, k]) * np.uint64(0x9E3779B97F4A7C15))
    return key


def band_keys(ranks: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all lines, hashes of the smallest ranks of their words, and how many each line has."""
    out, count = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for at, upto, lo, hi in _chunks(starts, len(words)):
        least = np.minimum.reduceat(ranks[words[lo:hi]], starts[at:upto] - lo, axis=0)
        least = least.astype(np.uint64)
        short = np.diff(np.r_[starts[at:upto], hi]) <= SHORT
        keys = np.empty((upto - at, BANDS + SHORT_BANDS), dtype=np.uint64)
        keys[:, :BANDS] = _keys(least.reshape(-1, BANDS, ROWS), 1)
        keys[short, BANDS:] = _keys(least[short, : SHORT_BANDS * SHORT_ROWS].reshape(-1, SHORT_BANDS, SHORT_ROWS), BANDS + 1)
        out.append(keys[short[:, None] | (np.arange(keys.shape[1]) < BANDS)].view(np.int64))
        count.append(BANDS + SHORT_BANDS * short)
    return np.concatenate(out), np.concatenate(count)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, of which few are Python objects at a time."""
    for k in range(0, batch.num_rows, ROWS_HELD):
        yield from zip(*(batch[name].slice(k, ROWS_HELD).to_pylist() for name in names), strict=True)


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line of enough words: doc, doc_id, line number, sid (hash of the normalised line), fingerprint,
    length of the normalised line and its keys.

    Of equal lines that follow soon on each other just the first has the keys.
    """

    def frame(known: Words, doc: list[int], number: list[int], count: list[int], ids: array) -> pa.RecordBatch:
        known.settle()
        at = np.array(ids, dtype=np.int32)
        line = np.repeat(np.arange(len(count)), count)
        real = known.sizes[at] > 0
        enough = np.bincount(line[real], minlength=len(count)) >= MIN_WORDS
        real &= enough[line]
        at, line = at[real], line[real]
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        words = known.hashes[at].tobytes()
        sid = np.array([known.hash(words[8 * s : 8 * e]) for s, e in itertools.pairwise([*starts.tolist(), len(at)])], dtype=np.uint64)
        sid = (sid ^ np.uint64(1 << 63)).view(np.int64)
        sim = fingerprints(known.votes, at, starts)
        size = np.add.reduceat(known.sizes[at] + 1, starts) - 1 if len(at) else np.empty(0, dtype=np.int64)
        first = np.zeros(len(sid), dtype=bool)
        first[np.unique(sid, return_index=True)[1]] = True
        held = np.diff(np.r_[starts, len(at)])
        keys, many = band_keys(known.ranks, at[np.repeat(first, held)], np.cumsum(held[first]) - held[first])
        ends = np.zeros(len(sid) + 1, dtype=np.int32)
        ends[1:][first] = many
        keys = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys), mask=pa.array(~first))
        columns = [np.array(doc, dtype=np.int64)[enough], np.array(number, dtype=np.int32)[enough], sid, sim.view(np.int64), size]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), keys], names=["doc", "line", "sid", "sim", "size", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        doc, number, count, ids = [], [], [], array("i")
        for b in batches:
            for key, text in _rows(b, "doc", "text"):
                # in lower case and without common marks at once, so that fewer words are met for the first time
                text = text.lower()
                for mark, space in ENDS:
                    text = text.replace(mark, space)
                for k, line in enumerate(text.split("\n")):
                    words = line.split()
                    if len(words) >= MIN_WORDS:
                        doc.append(key)
                        number.append(k)
                        count.append(len(words))
                        ids.extend(map(known.__getitem__, words))
                # whatever the size of a batch, few lines and words are held at a time
                if len(ids) >= HELD_WORDS or len(known) >= WORDS_KEPT:
                    yield frame(known, doc, number, count, ids)
                    known.shrink()
                    doc, number, count, ids = [], [], [], array("i")
        if doc:
            yield frame(known, doc, number, count, ids)

    return docs.select("doc", "text").filter("text IS NOT NULL").mapInArrow(run, "doc long, line int, sid long, sim long, size long, keys array<long>")


def _near(one: tuple[Column, Column], two: tuple[Column, Column]) -> Column:
    """Whether fingerprints and lengths leave it possible that lines (sim, size) are alike."""
    longest = F.greatest(one[1], two[1])
    fits = F.abs(one[1] - two[1]) <= F.floor(F.lit(1 - SIMILARITY) * longest + F.lit(1e-9))
    return fits & (F.bit_count(one[0].bitwiseXOR(two[0])) <= DISTANCE)


def stripped(a: str, b: str, most: int) -> tuple[str, str, bool | None]:
    """Both texts without the words that they begin and end with alike, whose edit distance is the same,
    and whether it is at most ``most`` if words exchanged in place, or mere lengths, tell."""
    u, v = a.split(" "), b.split(" ")
    shared = min(len(u), len(v))
    at, end = 0, 0
    while at < shared and u[at] == v[at]:
        at += 1
    while end < shared - at and u[-1 - end] == v[-1 - end]:
        end += 1
    u, v = u[at : len(u) - end], v[at : len(v) - end]
    a, b = " ".join(u), " ".join(v)
    if len(u) == len(v) and sum(max(len(x), len(y)) for x, y in zip(u, v, strict=True) if x != y) <= most:
        return a, b, True
    if not a or not b:
        # with words on one side only, a space goes with them if there are others
        return a, b, len(a or b) + (at + end > 0) <= most
    return a, b, True if max(len(a), len(b)) <= most else None


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Words exchanged in place bound it from above.  Where that does not settle it, the columns of
    the distance table are kept as whole numbers, a bit per row for each step up and down.  Of long
    lines some columns are written out: no way to the end is shorter than the best of one.
    """
    if abs(len(a) - len(b)) > most:
        return False
    a, b, known = stripped(a, b, most)
    if known is not None:
        return known
    has: dict[str, int] = {}
    for k, c in enumerate(a):
        has[c] = has.get(c, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, cost, left = every, 0, len(a), len(b)
    look = max(LOOK, len(b) // LOOKS)
    for c in b:
        same = has.get(c, 0)
        level = same | down
        carry = ((same & up) + up ^ up) | same
        rise, fall = down | every ^ ((carry | up) & every), up & carry
        cost += 1 if rise & top else -1 if fall & top else 0
        left -= 1
        if cost - left > most:
            return False
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | every ^ ((level | rise) & every)) & every, rise & level & every
        if left and left % look == 0 and _shortest(up, down, len(a), len(b) - left, left) > most:
            return False
    return cost <= most


def _shortest(up: int, down: int, rows: int, column: int, left: int) -> int:
    """The least of a column's distances, each with what the rows and columns that are left differ by."""
    step = [np.unpackbits(np.frombuffer(x.to_bytes(-(-rows // 8), "little"), dtype=np.uint8), count=rows, bitorder="little") for x in (up, down)]
    so_far = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(step[0].astype(np.int64) - step[1], out=so_far[1:])
    return column + int((so_far + np.abs(np.arange(rows - left, -left - 1, -1))).min())


def most_edits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The largest edit distance of lines of lengths x and y that are alike."""
    return np.floor((1 - SIMILARITY) * np.maximum(x, y) + 1e-9).astype(np.int64)


class Sequences:
    """How often each two-character sequence stands in each of some lines, by counter.

    One edit changes at most two sequences of either line, so two lines of which one has more than twice
    a number of sequences over the other are more than that number of edits apart.  Sequences that share a
    counter, and counters that are full, only make the difference smaller.
    """

    def __init__(self, told: list[str]):
        self.told = told
        self.counts, self.counted = np.empty((len(told), PAIR_COUNTS), dtype=np.uint8), np.zeros(len(told), dtype=bool)
        self.size = np.array([len(t) for t in told], dtype=np.int64)
        self.total = np.zeros(len(told), dtype=np.int64)

    def _count(self, lines: np.ndarray) -> None:
        """Count those lines that were not yet asked for."""
        lines = np.unique(lines[~self.counted[lines]])
        for k in range(0, len(lines), COUNTED):
            some = lines[k : k + COUNTED]
            code = np.frombuffer("".join([self.told[i] for i in some.tolist()]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            row = np.repeat(np.arange(len(some)), self.size[some])
            inside = np.flatnonzero(row[1:] == row[:-1])
            at = (code[inside] * np.uint32(31) + code[inside + 1]) % np.uint32(PAIR_COUNTS)
            found = np.bincount(row[inside] * PAIR_COUNTS + at, minlength=len(some) * PAIR_COUNTS)
            self.counts[some] = found = np.minimum(found, 255).reshape(len(some), PAIR_COUNTS)
            self.total[some] = found.sum(axis=1)
        self.counted[lines] = True

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """False where the counts prove that lines x and y are not alike."""
        out = np.empty(len(x), dtype=bool)
        self._count(np.concatenate([x, y]))
        most = most_edits(self.size[x], self.size[y])
        for k in range(0, len(x), COUNTED):
            i, j = x[k : k + COUNTED], y[k : k + COUNTED]
            a, b = self.counts[i], self.counts[j]
            apart = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
            # twice what the one with more of them has over the other
            out[k : k + len(i)] = apart + np.abs(self.total[i] - self.total[j]) <= 4 * most[k : k + len(i)]
        return out


def alike(one: list[str], two: list[str], strip: bool = False) -> np.ndarray:
    """Whether the edit similarity of normalised lines is high enough; ``strip``: words that they have in common are looked for first."""
    most = most_edits(*(np.array([*map(len, x)], dtype=np.int64) for x in (one, two)))
    out, rest = np.zeros(len(one), dtype=bool), np.arange(len(one))
    if strip:
        some, a, b = [], [], []
        for k, (x, y, bound) in enumerate(zip(one, two, most.tolist(), strict=True)):
            known = None
            if len(x) > STRIPPED and abs(len(x) - len(y)) <= bound:
                x, y, known = stripped(x, y, bound)
            if known is None:
                some.append(k)
                a.append(x)
                b.append(y)
            else:
                out[k] = known
        one, two, rest = a, b, np.array(some, dtype=np.int64)
    out[rest] = bounded(one, two, most[rest], within)
    return out


def _told(sids: DataFrame, docs: DataFrame, places: DataFrame) -> DataFrame:
    """sid and told (the normalised line) of the wanted sids; ``places`` says where each line stands.

    Only line numbers go to the texts; the sids are made again from the words.
    """
    lines = sids.join(places.select("sid", "doc", "line"), "sid").groupBy("doc").agg(F.collect_list("line").alias("lines"))
    lines = stored(lines)  # at most the lines of a document each
    count = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    side = F.broadcast(lines) if count <= BROADCAST_IDS else lines

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            out = []
            for text, asked in zip(b["text"], b["lines"], strict=True):
                parts = text.lower().split("\n")
                for k in asked:
                    words = [w for w in map(normal_word, parts[k].split()) if w]
                    hashes = np.array([digest(w) for w in words], dtype=np.uint64)
                    out.append((digest(hashes.tobytes()) - (1 << 63), " ".join(words)))
            yield pd.DataFrame(out, columns=["sid", "told"])

    texts = docs.select("doc", "text").join(side, "doc").select("text", "lines").mapInPandas(run, "sid long, told string")
    texts = stored(texts.dropDuplicates(["sid"]))
    discard(lines)
    return texts


def _alike(pairs: DataFrame, docs: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines whose edit similarity is high enough, stored."""
    texts = _told(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), docs, places)
    both = pairs.join(texts.select(F.col("sid").alias("a"), F.col("told").alias("ta")), "a")
    both = both.join(texts.select(F.col("sid").alias("b"), F.col("told").alias("tb")), "b")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one, two, at = b["ta"].tolist(), b["tb"].tolist(), np.arange(len(b))
            some = np.flatnonzero(Sequences(one + two).near(at, at + len(b)))
            fits = alike([one[k] for k in some.tolist()], [two[k] for k in some.tolist()], strip=True)
            yield b.iloc[some[fits]][["a", "b"]]

    found = stored(both.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long"))
    discard(texts)
    return found


def _close(rows: pd.DataFrame):
    sim = rows["sim"].to_numpy().view(np.uint64)
    return lambda x, y: np.bitwise_count(sim[x] ^ sim[y]) <= DISTANCE


def _likely(rows: pd.DataFrame):
    return Sequences(rows["told"].tolist()).near


def _named(docs: DataFrame) -> DataFrame:
    """Documents with ``doc``, a hash of doc_id and text."""
    return docs.withColumn("doc", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text")))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc (hash of doc_id and text) and the sorted numbers of the lines to be removed."""
    rows = stored(occurrences(docs))
    ids = docs.select("doc", "doc_id")
    # a place of each class, all columns from the same row; all classes for the links, later only those that come twice
    places = stored(rows.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("doc", "line", "sim", "size")], F.count("*").alias("n")))
    # dealt out once for both uses; a class that comes in several places has its keys several times
    keys = rows.filter("keys IS NOT NULL").select("sid", F.explode("keys").alias("key")).filter("key IS NOT NULL").repartition("key")
    least = keys.groupBy("key").agg(F.min("sid").alias("pivot"), F.max("sid").alias("_m")).filter("pivot <> _m").select("key", "pivot")
    shared = stored(keys.join(least, "key").select("key", "sid", "pivot").distinct())
    # the keys are most of the table
    every, rows = rows, stored(rows.select("doc", "line", "sid"))
    discard(every)
    about = places.select("sid", "sim", "size")
    one, two = (about.select(F.col("sid").alias(x), F.struct("sim", "size").alias(f"_{x}")) for x in "ab")
    stars = shared.filter("sid <> pivot").select(F.col("pivot").alias("a"), F.col("sid").alias("b")).distinct().join(one, "a").join(two, "b")
    stars = stored(stars.filter(_near(*[(F.col(f"_{x}.sim"), F.col(f"_{x}.size")) for x in "ab"])).select("a", "b"))
    edges = _alike(stars, docs, places)
    discard(stars)
    roots = components(edges)
    for turn in range(TURNS):
        # lists whose members are still apart: everybody against another member
        apart = shared.select("key", "sid").join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left")
        apart = apart.withColumn("root", F.coalesce("root", "sid"))
        pivots = apart.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("sid", F.lit(turn)).alias("h"), "sid", "root")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")
        )
        pivots = pivots.filter("lo <> hi").select("key", F.col("p.sid").alias("a"), F.col("p.root").alias("_r"))
        met = apart.join(pivots, "key").filter("root <> _r").select("a", F.col("sid").alias("b")).distinct().join(one, "a").join(two, "b")
        met = stored(met.filter(_near(*[(F.col(f"_{x}.sim"), F.col(f"_{x}.size")) for x in "ab"])).select("a", "b"))
        new = _alike(met, docs, places)
        discard(met)
        if new.isEmpty():
            break
        roots = merged(roots, new)
    tell = lambda sids: about.select("sid", "sim").join(_told(sids, docs, places), "sid")
    more = stored(alike_across(shared.select("key", "sid").join(about.select("sid", "size"), "sid"), roots, tell, SIMILARITY, _close, _likely, alike))
    discard(shared)
    if not more.isEmpty():
        roots = merged(roots, more)
    linked = roots.select(F.col("node").alias("sid"), "root")
    linked = linked.union(linked.select(F.col("root").alias("sid"), "root").distinct())
    # only lines that come twice or are linked can go
    several = places.filter("n > 1").select("sid").join(linked, "sid", "full").select("sid", F.coalesce("root", "sid").alias("root"))
    some = stored(rows.select("doc", "line", "sid").join(several, "sid").join(ids.distinct(), "doc"))
    first = some.groupBy("root").agg(F.min(F.struct("doc_id", "doc", "line")).alias("keep"))
    gone = some.join(first, "root").filter(~((F.col("doc") == F.col("keep.doc")) & (F.col("line") == F.col("keep.line"))))
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """The documents without repeated lines, and the count of removed lines in ``lines_removed``.

    ``drop_emptied`` also leaves out documents that lost every line with a word.
    """
    key, gone, count = fresh(docs, "doc", "gone", "lines_removed")
    light = _named(docs.select("doc_id", "text"))
    found = repeated_lines(light)
    own = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))
    rows = docs.withColumn(key, own).join(found.select(F.col("doc").alias("_doc"), F.col("gone").alias(gone)), F.col(key) == F.col("_doc"), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains(F.col(gone), k))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    rows = rows.withColumn("text", text).withColumn(count, F.coalesce(F.size(gone), F.lit(0)))
    if drop_emptied:
        rows = rows.filter((F.col(count) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], count)
