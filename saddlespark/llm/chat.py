"""Chat formatting in budgeted windows.

Turns are marked ``<|im_start|>role`` newline text ``<|im_end|>`` newline.  Inside roles and texts
every ``<`` that is followed by bars gets one bar more, so no control string survives there
and taking the bar away again restores the text; newlines and backslashes of roles are escaped.

A conversation becomes windows of whole turns.  Prefix sums of the turns' tokens choose the
spans: a turn belongs to window floor(tokens that end with it / fresh budget), so a window has
at most twice that budget unless one turn alone is longer.  Later windows begin with the
system turn and with up to ``history`` of the turns before them, as far as the history budget
reaches; both are context only.  The loss mask covers the assistant texts that are new in a
window, so each is learnt once.

Long conversations: the prefix sums run in blocks of consecutive turns with a second level over
block totals.  Everything is native DataFrame code.

Cases: a null text is empty, a null role an empty role; rows with a null conv_id form one
conversation.  Turns with equal numbers go by role, then text; repeated rows are turns of their
own.  A system turn is retained if it opens the conversation.  Turns are never cut: one
longer than the budget has a window to itself or with short ones.  Further columns are left out.
An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words

START, STOP = "<|im_start|>", "<|im_end|>\n"
FRESH = 256  # tokens (words and marks) of new turns that choose a window
HISTORY_TOKENS = 128
HISTORY_TURNS = 2
MARK_TOKENS = 3  # what the template adds to a turn
BLOCK = 1024  # consecutive turn numbers summed together


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)", r"<|$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    # a backslash before n is a newline only if it is not itself escaped: protect the pairs first
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def numbered(turns: DataFrame) -> DataFrame:
    """conv, role, text, tokens and, per conversation, the number of the turn and the tokens before it."""
    t = turns.select(
        F.struct("conv_id").alias("conv"),  # a struct is never null, so joins on it need no special case
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        (count_words(F.col("text")) + MARK_TOKENS).alias("tokens"),
        F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / F.lit(BLOCK)).alias("block"),
    )
    totals = t.groupBy("conv", "block").agg(F.sum("tokens").alias("_t"), F.count("*").alias("_n"))
    earlier = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        F.col("conv").alias("_c"),
        F.col("block").alias("_b"),
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_t0"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
    )
    order = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    done = order.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumns({"_ti": F.coalesce(F.sum("tokens").over(done), F.lit(0)), "_ni": F.row_number().over(order) - 1})
    t = t.join(starts, (F.col("conv") == F.col("_c")) & (F.col("block") == F.col("_b")))
    return t.select("conv", "role", "text", "tokens", (F.col("_n0") + F.col("_ni")).alias("n"), (F.col("_t0") + F.col("_ti")).alias("before"))


def windows(
    turns: DataFrame, fresh: int = FRESH, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS
) -> DataFrame:
    """One row per window: conv_id, window, formatted text, n_context (turns repeated at its front) and loss spans.

    ``loss`` is an array of (start, length) in code points of ``formatted``.
    """
    t = numbered(turns)
    t = t.withColumn("window", F.floor((F.col("before") + F.col("tokens") - 1) / F.lit(fresh)))
    # A turn is history of the window that one of the next few turns opens.  Those turns are found
    # by an exact join on the turn number, of one small row per opening turn and distance.
    opens = (
        t.groupBy("conv", "window").agg(F.min("n").alias("open"), F.min("before").alias("from"))
        .withColumnRenamed("conv", "_c").withColumnRenamed("window", "_w")
    )
    ask = opens.select("_c", "_w", "from", F.explode(F.sequence(F.lit(1), F.lit(history_turns))).alias("_d"), "open")
    ask = ask.select("_c", "_w", "from", (F.col("open") - F.col("_d")).alias("_n")).filter("_n >= 0")
    light = t.select("conv", "n", "before", "role", "text")
    back = light.join(ask, (F.col("conv") == F.col("_c")) & (F.col("n") == F.col("_n")))
    back = back.filter(F.col("from") - F.col("before") <= history_tokens)
    system = light.filter((F.col("n") == 0) & (F.col("role") == "system")).select("conv", "n", "role", "text")
    # the system turn is context of every window but its own and those that have it as history
    front = system.join(opens.filter("open > 0"), (F.col("conv") == F.col("_c"))).select("conv", "_w", "n", "role", "text")
    again = back.select("conv", "_w", "n", "role", "text").filter(~((F.col("n") == 0) & (F.col("role") == "system")))
    rows = t.select("conv", F.col("window").alias("_w"), "n", "role", "text", F.lit(False).alias("context"))
    rows = rows.unionByName(front.unionByName(again).withColumn("context", F.lit(True)))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    rows = rows.select(
        "conv",
        "_w",
        F.struct(
            "n",
            "context",
            F.concat(head, body, F.lit(STOP)).alias("piece"),
            F.char_length(head).alias("head"),
            F.when((F.col("role") == "assistant") & ~F.col("context"), F.char_length(body)).alias("loss"),
        ).alias("p"),
    )
    made = rows.groupBy("conv", "_w").agg(F.array_sort(F.collect_list("p")).alias("p"))
    sizes = F.transform("p", lambda x: F.char_length(x["piece"]))
    place = F.aggregate(
        sizes, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")),
    )["out"]
    made = made.withColumn("at", place)
    spans = F.transform(
        F.filter(F.arrays_zip("p", "at"), lambda z: z["p"]["loss"].isNotNull()),
        lambda z: F.struct((z["at"] + z["p"]["head"]).alias("start"), z["p"]["loss"].alias("length")),
    )
    return made.select(
        F.col("conv.conv_id").alias("conv_id"),
        F.col("_w").alias("window"),
        F.concat_ws("", F.transform("p", lambda x: x["piece"])).alias("formatted"),
        F.size(F.filter("p", lambda x: x["context"])).alias("n_context"),
        spans.alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """From windows alone: conv_id, window, the new turns as (role, text), and the text under the mask."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda x, k: (k >= F.col("n_context")) & (x != ""))
    bare = F.transform(pieces, lambda x: F.substring(x, len(START) + 1, (1 << 31) - 1))
    turn = lambda x: F.struct(
        unescape_role(F.substring_index(x, "\n", 1)).alias("role"),
        unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text"),
    )
    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return made.select(
        "conv_id", "window", F.char_length("formatted").cast("long").alias("chars"),
        F.transform(bare, turn).alias("turns"), F.array_join(under, "").alias("learnt"),
    )
