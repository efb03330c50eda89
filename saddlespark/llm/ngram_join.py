"""Exact Jaccard join of documents on sets of word n-grams, size-aware.

Documents with the same set are one class.  Two sets link when percent * |union| <= 100 *
|intersection|; components of links are returned.  Sets go two ways by size, with the boundary
where the cost of one passes that of the other:

* Light sets enumerate their subsets of exactly the sizes that a link with each partner size
  requires.  Sharing such a subset is a link, so every subset seen by both sizes links its
  owners; a star to the smallest owner is enough for the component.
* Heavy sets (and light ones with a heavy partner size) put their rarest n-grams into inverted
  lists: as many as it takes for two linked sets to share one.  Rarity is estimated over all
  documents by a fixed-size count sketch; its errors cost time, never results.

Lists are scanned twice.  First every set is held against one set of its list, which joins
groups of near copies without forming their pairs.  Then pairs of different components are
held against each other inside the lists, in blocks of bounded size; blocks that lie in one
component are never paired.  Parity bitmaps of the sets, longer for larger
sets, bound the symmetric difference from below and stop most pairs.  The components that the
others would connect make one list each, and there the sets themselves are intersected.

Cases: null, empty and blank texts have an empty set, n_shingles 0, and are linked with nothing.
Texts shorter than an n-gram have their whole sequence as the only one.  Equal texts, ties and
repeated rows are one class; a repeated doc_id belongs to the class of each of its texts.  A
document without doc_id is linked with nothing and has no component_id.  Words
and n-grams are compared by 64-bit hashes, classes by a 64-bit hash of the sorted n-grams.
Other columns are left out (``distinct_documents`` keeps them).  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, stored
from .components import components, merged
from .lists import pairs_across

SKETCH_BITS = 20  # counters per row of the sketch; two rows of four bytes each: 8 MB in all
BITMAP_BITS = 512  # at least; larger sets have the power of two that is at most their size
MANY = 16  # members from which a list gets several pivots
WORDS_KEPT = 1 << 18  # word hashes that a worker remembers
ENTRIES_HELD = 1 << 17  # list entries that a task hands on at once
TEXTS_AT_ONCE = 256  # whose sets are handed on together
GRAMS_HELD = 1 << 17  # n-grams of a block whose sets are intersected: 1 MB, unless a set is larger
HELD = 1 << 17  # numbers of bitmaps that are compared at once
BROADCAST_IDS = 1 << 20  # ids of 8 bytes: 8 MB; more go through a shuffled join

# ---- sizes -----------------------------------------------------------------------------


def overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection with which sets of n and m link."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes that a set of n can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n: int, percent: int) -> int:
    """How many of its n-grams a set lists: one more than it may lack of a partner's."""
    return n - -(-percent * n // 100) + 1


def subset_keys(n: int, percent: int) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent) if m)


def boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which listing subsets costs less than scanning lists."""
    n = 0
    while subset_keys(n + 1, percent) <= max(prefix(n + 1, percent) * mean_list, n + 2):
        n += 1
    return n


# ---- sets of a text --------------------------------------------------------------------


class Shingles(dict):
    """Hashes of a text's n-grams, each once, sorted; word hashes are remembered."""

    def __init__(self, words: int):
        import xxhash

        super().__init__()
        self.words, self.hash = words, xxhash.xxh64_intdigest
        self.factors = [np.uint64(self.hash(bytes([k])) | 1) for k in range(words)]

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        out = self[word] = self.hash(word)
        return out

    def of(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know just the ASCII letters and white space
        found = [self[w] for w in text.encode("utf-8", "surrogatepass").lower().split()] if text else []
        if not found:
            return np.empty(0, dtype=np.uint64)
        w = np.array(found, dtype=np.uint64)
        n = max(1, len(w) - self.words + 1)
        h = np.full(n, min(len(w), self.words), dtype=np.uint64)
        for k in range(min(len(w), self.words)):
            h += w[k : k + n] * self.factors[k]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)  # the mixing constant of splitmix64
        h ^= h >> np.uint64(32)
        return np.unique(h)

    def key(self, s: np.ndarray) -> int:
        return self.hash(s.tobytes()) - (1 << 63)


def cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two sketch counters of each n-gram."""
    low = np.uint64((1 << SKETCH_BITS) - 1)
    return (s & low).astype(np.int64), ((s >> np.uint64(30)) & low).astype(np.int64) + (1 << SKETCH_BITS)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the numbers of n-grams per bit; a long bitmap is folded to a shorter one by halves."""
    size = max(BITMAP_BITS, 1 << (len(s).bit_length() - 1))
    at = (s >> np.uint64(32)).astype(np.int64) % size
    return np.packbits(np.bincount(at, minlength=size) & 1).tobytes()


# ---- passes over the texts -------------------------------------------------------------

CHUNK = 1 << 14  # counters in a row of a shuffled sketch


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, sid and bitmap of every document; and, with a chunk number, parts of the sketch."""
    names = {"doc_id": pa.int64(), "n": pa.int64(), "sid": pa.int64(), "bits": pa.binary(), "chunk": pa.int64()}
    schema = pa.schema(list(names.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, counts = Shingles(words), np.zeros(2 << SKETCH_BITS, dtype=np.uint32)
        for b in batches:
            out = []
            for text in b.column("text"):
                s = make.of(text.as_py())
                for c in cells(s):
                    np.add.at(counts, c, 1)
                out.append((len(s), make.key(s) if len(s) else None, bitmap(s) if len(s) else None))
            n, sid, bits = zip(*out, strict=True) if out else ((), (), ())
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(out), pa.int64())], schema=schema)
        for k in range(len(counts) // CHUNK):
            part = counts[k * CHUNK : (k + 1) * CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"bits": zlib.compress(part.tobytes(), 1), "chunk": k}], schema=schema)

    return _texts(docs).mapInArrow(run, "doc_id long, n long, sid long, bits binary, chunk long")


def _sketch(parts: DataFrame) -> np.ndarray:
    """Counters over all documents: a fixed number of them, whatever the input."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), dtype=np.uint32).astype(np.uint64) for x in group["bits"])
        return pd.DataFrame({"chunk": [key[0]], "bits": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    counts = np.zeros(2 << SKETCH_BITS, dtype=np.uint32)
    # parts of tasks are added up in two steps, so that no group grows with the number of tasks at once
    salted = parts.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(16)))
    half = salted.groupBy("chunk", "piece").applyInPandas(add, "chunk long, bits binary")
    packed = half.mapInPandas(lambda it: (b.assign(bits=[zlib.compress(x, 1) for x in b["bits"]]) for b in it), "chunk long, bits binary")
    for r in packed.groupBy("chunk").applyInPandas(add, "chunk long, bits binary").toLocalIterator():
        counts[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["bits"]), dtype=np.uint32)
    return counts


def _keys(docs: DataFrame, words: int, percent: int, sketch: np.ndarray, light: int) -> DataFrame:
    """Rows (key, sid, n, lo, hi): list entries with lo null, subsets for the sizes lo and hi otherwise."""
    counts = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([(c, pa.int64()) for c in ("key", "sid", "n", "lo", "hi")])

    def subsets(make: Shingles, s: np.ndarray) -> Iterator[tuple[int, int, int]]:
        n = len(s)
        for m in partners(n, percent):
            if not 0 < m <= light:
                continue
            lo, hi = min(n, m), max(n, m)
            tail = bytes([lo, hi])
            for part in itertools.combinations(s.tolist(), overlap(n, m, percent)):
                yield make.hash(np.array(part, dtype=np.uint64).tobytes() + tail) - (1 << 63), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen, count = Shingles(words), set(), counts.value
        cols: list[list[np.ndarray]] = [[], [], []]
        few: list[tuple[int, ...]] = []

        def told() -> Iterator[pa.RecordBatch]:
            if few:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*few, strict=True)], schema=schema)
            if cols[0]:
                made = [pa.array(np.concatenate(x)) for x in cols]
                none = pa.nulls(len(made[0]), pa.int64())
                yield pa.RecordBatch.from_arrays([*made, none, none], schema=schema)
            for held in (few, *cols):
                held.clear()

        size = 0
        for b in batches:
            for text in b.column("text"):
                s = make.of(text.as_py())
                n = len(s)
                sid = make.key(s) if n else None
                if sid is None or sid in seen:
                    continue
                if len(seen) >= WORDS_KEPT:
                    seen.clear()
                seen.add(sid)
                if n <= light:
                    few += [(k, sid, n, lo, hi) for k, lo, hi in subsets(make, s)]
                if partners(n, percent)[-1] > light:
                    a, c = cells(s)
                    first = np.lexsort((s, np.minimum(count[a], count[c])))[: prefix(n, percent)]
                    cols[0].append(s[first].view(np.int64))
                    cols[1].append(np.full(len(first), sid, dtype=np.int64))
                    cols[2].append(np.full(len(first), n, dtype=np.int64))
                    size += len(first)
                if size + len(few) >= ENTRIES_HELD:
                    yield from told()
                    size = 0
        yield from told()

    return _texts(docs).mapInArrow(run, "key long, sid long, n long, lo long, hi long")


# ---- pairs -----------------------------------------------------------------------------


class Bitmaps:
    """The bitmaps of some sets, each at its own length and all shorter ones."""

    def __init__(self, column: pd.Series):
        sizes = np.array([len(x) for x in column], dtype=np.int64) // 8
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # row of each set or -1, bitmaps
        width, longer = int(sizes.max(initial=0)), np.empty((0, 0), dtype=np.uint64)
        at_longer = np.empty(0, dtype=np.int64)
        while width >= BITMAP_BITS // 64:
            own = np.flatnonzero(sizes == width)
            bits = np.frombuffer(b"".join(column.iloc[own]), dtype=np.uint64).reshape(len(own), width)
            if len(at_longer):
                bits = np.concatenate([longer[:, :width] ^ longer[:, width:], bits])
            at = np.concatenate([at_longer, own])
            row = np.full(len(sizes), -1, dtype=np.int64)
            row[at] = np.arange(len(at))
            self.levels.append((row, bits))
            longer, at_longer, width = bits, at, width // 2
        self.levels.reverse()

    def apart(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
        """True where the bitmaps prove that sets x and y, of sizes n and m, do not link.

        They differ in at least as many n-grams as bits; linked sets in at most (n + m) - 2 * overlap.
        """
        most = n + m - 2 * (-(-percent * (n + m) // (100 + percent)))
        out = percent * np.maximum(n, m) > 100 * np.minimum(n, m)
        for row, bits in self.levels:
            left = np.flatnonzero(~out & (row[x] >= 0) & (row[y] >= 0))
            step = max(1, HELD // bits.shape[1])
            for k in range(0, len(left), step):
                some = left[k : k + step]
                least = np.bitwise_count(bits[row[x[some]]] ^ bits[row[y[some]]]).sum(axis=1, dtype=np.int64)
                out[some] = least > most[some]
        return out


def _probable(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps leave."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if len(p):
                x, y = np.arange(len(p)), np.arange(len(p), 2 * len(p))
                out = Bitmaps(pd.concat([p["ba"], p["bb"]])).apart(x, y, p["na"].to_numpy(), p["nb"].to_numpy(), percent)
                yield p.loc[~out, ["a", "b"]]

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ba", "bb").mapInPandas(run, "a long, b long")


def _grams(wanted: DataFrame, docs: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """sid and grams (the sorted n-grams, 8 bytes each) of the wanted sids, made from the texts again. Stored."""
    ids = stored(wanted.join(sets.select("sid", "doc_id", "n"), "sid"))
    needed = ids.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        needed = F.broadcast(needed)

    def make_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = Shingles(words)
        for b in batches:
            for k in range(0, len(b), TEXTS_AT_ONCE):
                made = [make.of(t) for t in b["text"].iloc[k : k + TEXTS_AT_ONCE]]
                yield pd.DataFrame({"sid": [make.key(s) for s in made], "grams": [s.tobytes() for s in made]})

    texts = _texts(docs).filter("text IS NOT NULL").join(needed, "doc_id", "left_semi")
    made = texts.mapInPandas(make_sets, "sid long, grams binary")
    # a doc_id that stands for several texts may bring other sets along
    made = stored(made.join(ids.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]))
    discard(ids)
    return made


def _link(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two sets link."""
    s, t = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    common = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * common >= percent * (len(s) + len(t) - common)


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by intersecting their sets. Stored."""
    made = _grams(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), docs, sets, words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [_link(x, y, percent) for x, y in zip(p["ga"], p["gb"], strict=True)]
            yield p.loc[np.array(keep, dtype=bool), ["a", "b"]]

    joined = pairs.join(made.select(F.col("sid").alias("a"), F.col("grams").alias("ga")), "a")
    joined = joined.join(made.select(F.col("sid").alias("b"), F.col("grams").alias("gb")), "b")
    found = stored(joined.select("a", "b", "ga", "gb").mapInPandas(run, "a long, b long"))
    discard(made)
    return found


def _unproved(percent: int):
    """The test of pairs inside lists: the bitmaps do not rule a link out."""

    def test(rows: pd.DataFrame):
        bits, n = Bitmaps(rows["bits"]), rows["n"].to_numpy()
        return lambda x, y: ~bits.apart(x, y, n[x], n[y], percent)

    return test


def _across(lists: DataFrame, roots: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) that connect the components ``roots`` where sets that share a list link; stored, None if there are none.

    A pair that the bitmaps leave may come in many lists and with many others.  So the lists only
    tell which components such pairs connect: what a task hands on is no more than the components
    it has met.  The members of components connected in that way then make one list, whose blocks
    bring their sets along, and links are settled there.
    """
    tell = lambda sids: sets.select("sid", "n", "bits")
    every = lambda rows: lambda x, y: True
    met = stored(pairs_across(lists, roots, tell, _unproved(percent), every))
    if met.isEmpty():
        return None
    for x in "ab":
        met = met.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")), x, "left").withColumn(x, F.coalesce(f"_{x}", x)).drop(f"_{x}")
    groups = components(met)
    groups = groups.union(groups.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("_r"), F.col("root").alias("key"))
    named = sets.join(roots.withColumnsRenamed({"node": "sid", "root": "_r"}), "sid", "left").withColumn("_r", F.coalesce("_r", "sid"))
    members = stored(named.join(groups, "_r").select("key", "sid", F.col("n").alias("size")))
    grams = _grams(members.select("sid"), docs, sets, words)
    tell = lambda sids: sets.select("sid", "n", "bits").join(grams, "sid")

    def settle(rows: pd.DataFrame):
        made = rows["grams"].tolist()
        return lambda x, y: _link(made[x], made[y], percent)

    links = stored(pairs_across(members, roots, tell, _unproved(percent), settle, GRAMS_HELD))
    discard(grams)
    return links


# ---- the join --------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id in reach) of every document."""
    raw = stored(_signatures(docs, words))
    sid = F.when(F.col("doc_id").isNotNull(), F.col("sid"))
    sigs = raw.filter("chunk IS NULL").select("doc_id", "n", sid.alias("sid"), "bits")
    sketch = _sketch(raw.filter("chunk IS NOT NULL").select("chunk", "bits"))
    # how many others an n-gram of the corpus meets, less what chance adds to its counter
    first = sketch[: 1 << SKETCH_BITS].astype(np.float64)
    noise = float(np.median(first))
    mean = float((first * np.maximum(first - noise, 0)).sum() / max(first.sum(), 1)) + 1
    light = boundary(mean, percent)
    sets = stored(sigs.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    subsets, lists = _alive(_keys(docs, words, percent, sketch, light))
    stars = _stars(lists)
    edges = _linked(stored(_probable(stars, sets, percent)), docs, sets, words, percent).union(subsets).distinct()
    roots = components(edges)
    more = _across(lists, roots, docs, sets, words, percent)
    discard(lists)
    if more is not None:
        roots = merged(roots, more)
    named = sets.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "doc_id", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = named.join(least, "root").select("sid", "component_id")
    out = sigs.join(named, "sid", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _alive(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by shared subsets, and the entries (key, sid) of lists with different sets.

    Subsets link if sets of both their sizes have them.
    """
    # written as a table, because it is read more than once and a second pass over the texts costs more
    every = stored(keys)
    parts = every.filter("lo IS NOT NULL")
    found = parts.groupBy("key", "lo", "hi").agg(
        F.min("sid").alias("a"), F.max("sid").alias("_other"), F.min("n").alias("_n0"), F.max("n").alias("_n1")
    )
    found = found.filter("a <> _other AND (lo = hi OR _n0 <> _n1)").select("key", "lo", "hi", "a")
    subsets = parts.join(found, ["key", "lo", "hi"]).filter("sid <> a").select("a", F.col("sid").alias("b")).distinct()
    entries = every.filter("lo IS NULL").select("key", "sid")
    shared = entries.groupBy("key").agg(F.min("sid").alias("_a"), F.max("sid").alias("_b")).filter("_a <> _b").select("key")
    subsets, lists = stored(subsets), stored(entries.join(shared, "key"))
    discard(every)
    return subsets, lists


def _stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a list and the list's pivot; long lists have up to four pivots.

    In a group of near copies two copies can be too far apart although both are near a third, so
    several pivots leave fewer pairs of different components for the second scan.
    """
    other = [F.min(F.struct(F.xxhash64("sid", F.lit(k)).alias("h"), "sid"))["sid"] for k in range(2)]
    ends = lists.groupBy("key").agg(F.min("sid").alias("p"), F.array(F.min("sid"), F.max("sid"), *other).alias("ps"), F.count("*").alias("_n"))
    pivots = ends.select("key", F.when(F.col("_n") >= MANY, F.array_distinct("ps")).otherwise(F.array("p")).alias("ps"))
    pairs = lists.join(pivots, "key").select("sid", F.explode("ps").alias("p")).filter("sid <> p")
    return pairs.select(F.least("p", "sid").alias("a"), F.greatest("p", "sid").alias("b")).distinct()


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one with the smallest doc_id and, below it, hash of the text.

    Documents are told apart by doc_id and text, so other texts under a repeated doc_id are
    documents of their own; equal rows stay once.  Documents without doc_id are linked among each
    other, also by way of others, and one of each component stays beside the one with a doc_id.
    Documents without words are linked with nothing and stay.
    """
    key, part = fresh(docs, "_key", "_part")
    own = F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text").isNull(), F.col("text"))
    found = near_duplicates(docs.select(own.alias("doc_id"), "text"), words, percent)
    found = found.select(F.col("doc_id").alias(key), F.col("component_id").alias(part)).distinct()
    ids = docs.select(own.alias(key), "doc_id", F.xxhash64("text").alias("text")).distinct()
    first = ids.join(found, key).groupBy(part, F.col("doc_id").isNull()).agg(F.min(F.struct("doc_id", "text", key)).alias("first"))
    kept = first.select(F.col(f"first.{key}").alias(key))
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])
