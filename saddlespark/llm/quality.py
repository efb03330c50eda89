"""Quality rules: a table of thresholds compiled into one projection.

Every measure is a native expression over the whole text, every rule compares one measure
with its bounds, and a document is kept if no rule fails.  Nothing is shuffled, so hot
sources and copies cost what any other row costs.

Cases: a null text has no words and is rejected; so are empty and blank texts.  Repeated rows
are judged each for itself, all columns pass through unchanged, an empty table gives an empty
table.  Long texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, fresh, split_words

WINDOW = 8  # words of a repeated window
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Fails a document whose ``measure`` lies outside [low, high]."""

    measure: str
    low: float | None = None
    high: float | None = None


# The widest ranges that running prose of any of the four languages stays inside.
RULES = (
    Rule("n_words", low=20),
    Rule("repeat_ratio", high=0.3),
    Rule("mean_word_chars", low=2.5, high=14.0),
    Rule("symbol_ratio", high=0.1),
    Rule("bang_ratio", high=0.3),
    Rule("upper_ratio", high=0.5),
    Rule("alpha_word_ratio", low=0.7),
    Rule("stop_word_ratio", low=0.01),
    Rule("adjacent_ratio", high=0.3),
    Rule("dup_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("bullet_line_ratio", high=0.9),
)

# Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in is that it for was on are as with be by this from or an at not have "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans au par sur pas plus "
    "el los las y del se con por una su para al lo como no"
).split()

# Marks that may follow a stop word.
MARKS = ".,;:!?"


def ascii_count(text: Column, chars: str) -> Column:
    """How often the given ASCII characters occur: the bytes that taking out each of them saves."""
    saved = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars]
    return reduce(lambda a, b: a + b, saved).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text.

    Hashes of all windows tell the texts without any repeat; only the others compare the
    windows themselves, sorted, by neighbours.  A word inside several such windows counts once.
    """

    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i + k) for k in range(WINDOW)]  # slice() would copy the whole array each time

    def exact(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
        rows = F.array_sort(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(w, i)).alias("s"), i.alias("i"))))
        places = bind(
            rows,
            lambda r: F.array_sort(
                F.transform(
                    F.filter(r, lambda x, k: (F.get(r, k - 1)["s"] == x["s"]) | (F.get(r, k + 1)["s"] == x["s"])),
                    lambda x: x["i"],
                )
            ),
        )
        gaps = bind(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0),
                lambda a, x: a + x,
            ),
        )
        return gaps

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*at(w, i)))
        unique = bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
        return F.when(F.size(w) < WINDOW + 1, F.lit(0)).when(unique, F.lit(0)).otherwise(exact(w))

    return bind(words, count).cast("long")


def counted(t: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts over a whole text, its words and its lines that have a word, by name."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": ascii_count(t, SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(words),
        "n_lines": F.size(lines).cast("long"),
        "n_bangs": ascii_count(t, "!?"),
        "n_upper": (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).cast("long"),
        "n_alpha_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(MARKS))).isin(STOP_WORDS))).cast("long"),
        "n_adjacent": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*\z"))).cast("long"),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"\A[\x20\x09-\x0D]*[-*•‣◦·][\x20\x09-\x0D]"))).cast("long"),
    }


def measures(text: Column) -> Column:
    """A struct of all counts; text, words and lines are made once each."""
    t = F.coalesce(text, F.lit(""))
    parts = F.struct(
        t.alias("t"),
        split_words(text).alias("w"),
        F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    return bind(parts, lambda p: F.struct(*[v.alias(k) for k, v in counted(p["t"], p["w"], p["l"]).items()]))


def ratios(c: Column) -> dict[str, Column]:
    """What the rules look at, from the counts."""

    def share(a: str, b: str) -> Column:
        return F.when(c[b] > 0, c[a] / c[b]).otherwise(0.0)

    return {
        "n_words": c["n_words"].cast("double"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "bang_ratio": share("n_bangs", "n_words"),
        "upper_ratio": share("n_upper", "word_chars"),
        "alpha_word_ratio": share("n_alpha_words", "n_words"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "adjacent_ratio": share("n_adjacent", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": share("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": share("n_bullet_lines", "n_lines"),
    }


def verdict(counts: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """True if every rule of the table holds."""
    found, ok = ratios(counts), F.lit(True)
    for r in rules:
        if r.low is not None:
            ok = ok & (found[r.measure] >= F.lit(float(r.low)))
        if r.high is not None:
            ok = ok & (found[r.measure] <= F.lit(float(r.high)))
    return ok


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The counts of a text and the verdict ``kept`` on it, as a struct."""
    return bind(measures(text), lambda c: F.struct(c.alias("counts"), verdict(c, rules).alias("kept")))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents with a struct column ``quality`` of counts and verdict (``quality_`` if that name is taken)."""
    return docs.withColumn(fresh(docs, "quality")[0], judged(F.col(text), rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    return docs.filter(judged(F.col(text), rules)["kept"])
