"""Buckets of a candidate search, dealt to tasks so that no bucket is too large for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


def split_crowded(rows: DataFrame, keys: list[str], rep: str, most: int, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``block``, ``one`` and ``two``: where a key has more than ``most`` rows they are dealt into blocks by
    ``rep``, and each row goes to every pair of blocks that its own is part of, so that any two rows of the key still
    meet in one group (key, one, two).  ``counted`` may give the keys alone, if that is cheaper.
    """
    crowded = stored((rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > most), "crowded")
    if not crowded.head(1):
        return rows.withColumns({"block": F.lit(0), "one": F.lit(0), "two": F.lit(0)})
    parts = F.coalesce(F.ceil(F.col("rows") / most).cast("int"), F.lit(1))
    split = rows.join(crowded, keys, "left").withColumn("parts", parts).drop("rows")
    split = split.withColumn("block", F.pmod(F.xxhash64(rep), F.col("parts").cast("long")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return split.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "parts")


def split_near_pivot(rows: DataFrame, keys: list[str], rep: str, prints: list[str], near: int, most: int, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``one`` and ``two``, and edges (a, b, d), for a search that only asks what is connected.

    In a key of more than ``most`` rows, those within ``near`` differing bits of one row, the pivot, are linked with it
    and so with each other; only the rest is compared with all.  The rest and the others are dealt into blocks apart, and
    the groups are pairs of blocks with one of the rest in each: a bucket of near copies costs its rows and no square.
    """
    alone = {"one": F.lit(0), "two": F.lit(0)}
    large = (rows if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("rows")).where(F.col("rows") > most)
    large = stored(large.select(*keys), "crowded")
    if not large.head(1):
        return rows.withColumns(alone), None
    crowded = rows.join(large, keys, "left_semi")
    pivots = stored(crowded.groupBy(*keys).agg(F.min(F.struct(rep, *prints)).alias("pivot")), "crowded-pivots")
    distance = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"pivot.{p}"))) for p in prints[1:]), F.bit_count(F.col(prints[0]).bitwiseXOR(F.col(f"pivot.{prints[0]}"))))
    marked = rows.join(pivots, keys, "left").withColumn("d", distance.cast("int")).withColumn("held", F.col("d") <= near)
    sizes = marked.where("held IS NOT NULL").groupBy(*keys).agg(F.count(F.when(F.col("held"), 1)).alias("h"), F.count(F.when(~F.col("held"), 1)).alias("r"))
    sizes = stored(sizes.select(*keys, F.ceil(F.col("h") / most).cast("int").alias("h"), F.ceil(F.col("r") / most).cast("int").alias("r")), "crowded-blocks")
    edges = marked.where(F.col("held") & (F.col(rep) != F.col(f"pivot.{rep}"))).select(F.col(f"pivot.{rep}").alias("a"), F.col(rep).alias("b"), "d")
    dealt = marked.where("held IS NOT NULL").join(sizes, keys).where("r > 0")
    own = F.pmod(F.xxhash64(rep), F.when(F.col("held"), F.col("h")).otherwise(F.col("r")).cast("long")).cast("int")

    def pair(one: Column, two: Column) -> Column:
        return F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"))

    rest = F.sequence(F.lit(0), F.col("r") - 1)
    with_held = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda x: pair(x, F.col("own")))  # the pivot is held
    with_rest = F.transform(rest, lambda j: pair(F.col("h") + F.least(j, F.col("own")), F.greatest(j, F.col("own"))))
    groups = F.when(F.col("held"), F.transform(rest, lambda j: pair(F.col("own"), j))).otherwise(F.concat(with_held, with_rest))
    split = dealt.withColumn("own", own).withColumn("g", F.explode(groups)).select(*rows.columns, F.col("g.one").alias("one"), F.col("g.two").alias("two"))
    plain = marked.where("held IS NULL").select(*rows.columns).withColumns(alone)
    return plain.union(split), edges
