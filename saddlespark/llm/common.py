"""Column helpers shared by the text operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder

# Fixed by the task: what separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    Inside lambdas Spark would otherwise evaluate a shared expression once per element.
    """
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none.

    White space is first made one character, because splitting at a single character is much
    cheaper than at a pattern.
    """
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\f\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " ", -1), "")


def count_words(text: Column) -> Column:
    """Number of words, without building them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def unit_hash(seed: int, *keys: Column) -> Column:
    """A number above 0 and below 1 that depends on the keys and the seed only.

    The first 13 hex digits of an MD5 digest, so that any engine can repeat it.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    digits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(float(1 << 52))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the stems and clash with none of the frame's, by case-blind comparison."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: Column, pieces: int = 64) -> DataFrame:
    """The first ``n`` rows of each key, in two levels so that a hot key meets many tasks."""
    rank, piece = fresh(df, "_rank", "_piece")
    for level in (True, False):
        parts = [F.pmod(salt, F.lit(pieces)).alias(piece)] if level else []
        df = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys, *parts).orderBy(*order))).filter(F.col(rank) <= n)
    return df.drop(rank)


# Spark's setting: the shuffle files of a query go when it ends, not when the driver happens to collect garbage.
SHORT_LIVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """A result that several later steps read, as a table in the shared folder.

    Like a checkpoint it ends the lineage, but columns of it are read alone, numbers are stored
    compactly, and the shuffles that made it leave the disk at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(SHORT_LIVED, None)
    spark.conf.set(SHORT_LIVED, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHORT_LIVED)
        else:
            spark.conf.set(SHORT_LIVED, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove a table that ``stored`` made and nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
