"""Equal texts by distributed radix partitioning, most significant bytes first.

All texts start as one group.  Round k splits every open group by the next bytes of its texts,
``FIRST`` of them at first and four times the bytes read so far later on, so the rounds grow with
the logarithm of the longest shared beginning.  A group of one row is finished; so is a group whose texts end within the
bytes of the round, because their lengths and all their bytes agree.  Rows of finished groups
are left out of the next round.  Texts are compared byte by byte and never by a digest.

The texts are read once and stored as rows (row, level, digit), sorted by level in every part,
so that a round reads the pages of its own level only.  Splitting is an aggregation by (group,
digit), which combines before it shuffles, and a join back on the same key, which adaptive
execution splits where a group is hot; no group is gathered anywhere.  A group's number is its
smallest row.  Members of open groups are checkpointed each round.

Cases: texts are equal if they are after lower-casing A-Z only.  Null counts as empty, so null and
empty texts are one group.  Of equal texts the row with the largest doc_id stays (null is smaller
than all others); of rows that repeat doc_id and text exactly one stays, whichever, as they are
the same.  ``keep_id`` is null only if no row of the group has a doc_id.  Very long texts are used
whole.  Further columns, whatever their names, do not matter to ``exact_duplicates`` and come along
in ``distinct_texts``.  An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

FIRST = 32  # bytes of the first digit
STEP = 2  # digits end at FIRST * 4^k bytes: a shift of 2 bits a level
LEVELS = 14  # FIRST * 4^13 is past the longest text that Spark can hold


def normal_text(text: Column) -> Column:
    """The text in lower case, as far as letters A-Z go; texts of ASCII characters take the quick way."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, letters, letters.lower()))


def end_of(level: int) -> int:
    return FIRST << (STEP * level)


def digits(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The stored table (row, level, digit); rows of level 0 also have doc_id, text_sha256 and, if asked, all columns."""
    spark = docs.sparkSession
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")] if carry else []
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), normal_text(F.col("text")).alias("told"), *whole)
    last = F.size(F.filter(F.array(*[F.lit(end_of(k)) for k in range(LEVELS)]), lambda x: x <= F.octet_length("told")))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), last)))
    first = F.col("level") == 0
    end = F.expr(f"shiftleft({FIRST}L, {STEP} * level)")
    start = F.when(first, F.lit(0)).otherwise(F.expr(f"shiftleft({FIRST}L, {STEP} * (level - 1))"))
    digit = F.col("told").cast("binary").substr((start + 1).cast("int"), F.least(end - start, F.lit(2**31 - 1)).cast("int"))
    found = rows.select(
        "row",
        "level",
        digit.alias("digit"),
        F.when(first, F.col("doc_id")).alias("doc_id"),
        F.when(first, F.sha2("told", 256)).alias("text_sha256"),
        *[F.when(first, F.col("whole")).alias("whole") for _ in whole],
    )
    path = f"{shared_folder(spark)}/digits-{uuid.uuid4().hex}"
    found.sortWithinPartitions("level").write.parquet(path)
    return spark.read.parquet(path)


def groups_of_equals(stored: DataFrame) -> DataFrame:
    """row, doc_id and grp (the smallest row of its group) of every row whose text occurs more than once."""
    done = []
    active = None
    for level in itertools.count():
        if level == 0:
            now = stored.filter("level = 0").select("row", "doc_id", F.lit(0).cast("long").alias("grp"), "digit")
        else:
            now = active.join(stored.filter(F.col("level") == level).select("row", "digit"), "row")
        parts = now.groupBy("grp", "digit").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
        full = end_of(level) - (end_of(level - 1) if level else 0)
        members = now.join(parts, ["grp", "digit"])
        members = materialize(members.select("row", "doc_id", F.col("least").alias("grp"), (F.octet_length("digit") < full).alias("ended")))
        done.append(members.filter("ended").select("row", "doc_id", "grp"))
        active = members.filter("NOT ended").select("row", "doc_id", "grp")
        if active.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _decided(docs: DataFrame, carry: bool) -> DataFrame:
    stored = digits(docs, carry)
    equal = groups_of_equals(stored)
    stays = equal.groupBy("grp").agg(F.max(F.struct("doc_id", "row")).alias("stays"), F.count("*").alias("n"))
    told = equal.join(stays, "grp").select("row", "stays", "n")
    rows = stored.filter("level = 0").join(told, "row", "left")
    return rows.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("stays.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        *(["whole"] if carry else []),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the lower-cased text) of every row."""
    return _decided(docs, False)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    return _decided(docs, True).filter("kept").select([F.col(f"whole.`{c}`").alias(c) for c in docs.columns])
