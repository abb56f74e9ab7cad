"""Pairs of the rows of two tables, made block by block."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.sources.shared import written


def placed_among(rows: DataFrame, value: Column, bounds: Sequence[int], name: str) -> DataFrame:
    """``rows`` with ``name``: how many of the ascending ``bounds`` are less than ``value``, 0 for a null; a binary search in generated code."""
    steps = len(bounds).bit_length()
    filled = [*bounds, *[(1 << 63) - 1] * ((1 << steps) - 1 - len(bounds))]
    table = F.split(F.lit(",".join(map(str, filled))), ",").cast("array<bigint>")
    rows = rows.withColumn("__value", value).withColumn(name, F.lit(0))
    for half in (1 << step for step in reversed(range(steps))):
        # A step is a projection of its own, as it reads the one before twice.
        rows = rows.withColumn(name, F.col(name) + F.when(F.get(table, F.col(name) + (half - 1)) < F.col("__value"), half).otherwise(0))
    return rows.drop("__value")


def block_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, rows: int = 2000) -> DataFrame:
    """Every row of ``left`` with every row of ``right``, as structs ``a`` and ``b``.

    Both sides are dealt out to blocks of about ``rows`` rows, and each pair of blocks meets by an equality join: no side
    is sent whole to a task, whatever its size.
    """
    a, b, parts = block_keys(left.withColumn("a", F.struct(*left.columns)), right.withColumn("b", F.struct(*right.columns)), left_key, right_key, rows, rows)
    a, b = a.select("a", "__i", "__j").repartition(parts, "__i", "__j"), b.select("b", "__i", "__j").repartition(parts, "__i", "__j")
    return a.hint("shuffle_hash").join(b, ["__i", "__j"]).drop("__i", "__j")


def block_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_rows: int, right_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Both sides with ``__i`` and ``__j``, the pairs of blocks that their rows are in, and how many partitions these are worth.

    Blocks are few bytes that make many pairs, so the partitions are not left to Spark, which goes by bytes and puts all into a few tasks.
    """
    n, m = (max(1, -(-df.count() // rows)) for df, rows in ((left, left_rows), (right, right_rows)))
    i, j = (F.pmod(F.xxhash64(key), F.lit(k)).cast("int") for key, k in ((left_key, n), (right_key, m)))
    a = left.select("*", i.alias("__i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("__j"))
    b = right.select("*", j.alias("__j"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__i"))
    return a, b, min(n * m, max(2000, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def best_pairs(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, made: Callable[[DataFrame], DataFrame], top_k: int, by: str, tie: str,
    kept: Callable[[DataFrame], DataFrame] = lambda rows: rows, share: int = 32,
) -> DataFrame:
    """Of all pairs, the ``top_k`` of each row of ``left`` with the most ``points``, ties to the smaller right key, with their ``rank``.

    ``made`` turns pairs (``a``, ``b``, ``__least``, ``__last``) into rows with both keys (``by``, ``tie``), ``points``, whatever else the result has,
    and ``__least`` and ``__last`` as they are; ``kept`` drops rows that are no results. What points are made of should come out of an array of one
    element, so that the bounds stay behind it: as a condition of the join it would be made many times over. Pairs are not sorted as a whole: the last of the best
    pairs with a ``share``-th of the right side bounds what can be among the best of all, so a row behind it goes where it is made. That share
    is searched the same way, with a share of its own, so about ``share * top_k`` rows of each left row are left to sort in each turn.
    """
    left, right = written(left, "left"), written(right, "right")
    turns, total = 0, right.count()
    while total // share ** (turns + 1) >= 8 * top_k:
        turns += 1
    found, bounds = None, None
    for turn in range(turns, -1, -1):
        some = right.where(F.pmod(F.xxhash64(F.lit("share"), right_key), F.lit(share**turn)) == 0) if turn else right
        none = F.lit(None).cast(right.schema[right_key].dataType)
        asked = left.withColumns({"__least": F.lit(None).cast("long"), "__last": none}) if bounds is None else left.join(bounds, left_key, "left")
        rows = made(block_pairs(asked, some, left_key, right_key).select("a", "b", "a.__least", "a.__last")).where("points IS NOT NULL")
        if bounds is not None:
            # The first comparison leaves few rows for the second.
            rows = rows.where("__least IS NULL OR points >= __least").where(F.col("__least").isNull() | (F.col("points") > F.col("__least")) | (F.col(tie) <= F.col("__last")))
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("points"), tie))
        found = kept(rows.drop("__least", "__last")).withColumn("rank", place).where(F.col("rank") <= top_k)
        if turn:
            bounds = written(found.where(F.col("rank") == top_k).select(F.col(by).alias(left_key), F.col("points").alias("__least"), F.col(tie).alias("__last")), "bounds")
    return found


def best_unknown(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, made: Callable[[DataFrame], DataFrame], top_k: int, known: DataFrame, reads: Sequence[str], most: int = 256,
) -> DataFrame:
    """``best_pairs`` without the pairs of ``known`` (left_key, right_key), whose keys name the result's as well.

    ``reads`` are the columns of ``left`` that points are made of. Where many rows agree in them, only one of each kind is paired, for as many places more
    as any of them knows, and its list is that of all, less what each knows itself. A row that knows more than ``most`` is paired by itself.
    """
    there = written(known.join(left.select(left_key), left_key, "left_semi").select(left_key, right_key).distinct(), "known")
    number = there.groupBy(left_key).agg(F.count(F.lit(1)).alias("__known"))
    asked = written(left.join(number, left_key, "left").withColumn("__known", F.coalesce("__known", F.lit(0))), "asked")
    few = asked.where(F.col("__known") <= most)
    kinds = written(few.groupBy(*reads).agg(F.min(left_key).alias("__first"), F.count(F.lit(1)).alias("__rows"), F.max("__known").alias("__known")), "kinds")
    lists, rows, places = kinds.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0)), F.coalesce(F.max("__known"), F.lit(0))).first()
    unknown = lambda found: found.join(there, [left_key, right_key], "left_anti")
    # A longer list pays where it is that of several rows.
    if 8 * lists > rows:
        return best_pairs(asked.drop("__known"), right, left_key, right_key, made, top_k, left_key, right_key, unknown)
    alone = asked.where(F.col("__known") > most).drop("__known")
    firsts = kinds.select(F.col("__first").alias(left_key), *reads)
    found = written(best_pairs(firsts, right, left_key, right_key, made, top_k + places, left_key, right_key).withColumnRenamed(left_key, "__first"), "found")
    same = [few[c].eqNullSafe(F.col(f"__of_{c}")) for c in reads]
    of = few.join(kinds.select("__first", *(F.col(c).alias(f"__of_{c}") for c in reads)), same).select(left_key, "__first", (F.col("__known") + top_k).alias("__most"))
    # Of its kind's list a row needs as many places as it knows rows and may keep.
    met = of.join(found, "__first").where(F.col("rank") <= F.col("__most")).drop("__first", "__most", "rank")
    place = F.row_number().over(Window.partitionBy(left_key).orderBy(F.desc("points"), right_key))
    shared = unknown(met).withColumn("rank", place).where(F.col("rank") <= top_k)
    return shared if alone.isEmpty() else shared.unionByName(best_pairs(alone, right, left_key, right_key, made, top_k, left_key, right_key, unknown))


def block_join(left: DataFrame, right: DataFrame, by: str, left_key: str, right_key: str, rows: int = 2000) -> DataFrame:
    """The rows of ``left`` and ``right`` that agree in ``by``: that, and their other columns as structs ``a`` and ``b``.

    A value that many rows share is cut into blocks of about ``rows`` rows a side, whose pairs are keys of their own: no task
    gets all rows of a value. Blocks are counted by value, a row a value.
    """
    count = lambda df, name: df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    cut = count(left, "__n").join(count(right, "__m"), by)
    i, j = (F.pmod(F.xxhash64(key), F.col(n)).cast("int") for key, n in ((left_key, "__n"), (right_key, "__m")))
    a = left.join(cut, by).select(by, F.struct(*(c for c in left.columns if c != by)).alias("a"), i.alias("__i"), F.explode(F.sequence(F.lit(0), F.col("__m") - 1)).alias("__j"))
    b = right.join(cut, by).select(by, F.struct(*(c for c in right.columns if c != by)).alias("b"), j.alias("__j"), F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i"))
    return a.join(b, [by, "__i", "__j"]).drop("__i", "__j")


def member_pairs(met: DataFrame, members: DataFrame, left: str, right: str, kind: str, key: str, rows: int = 2000) -> DataFrame:
    """Pairs of kinds ``met`` (``left``, ``right`` and more) as pairs of the ``members`` (``kind``, ``key``) of both, by the same names.

    Members are arrays of about ``rows`` keys, which meet instead of them: pairs are made where they are used, and none is shuffled.
    """
    sizes = members.groupBy(kind).agg(F.ceil(F.count(F.lit(1)) / rows).alias("__blocks"))
    block = F.pmod(F.xxhash64(key), F.col("__blocks")).alias("__block")
    blocks = written(members.join(sizes, kind).groupBy(kind, block).agg(F.collect_list(key).alias("__keys")), "blocks")
    parts = max(1, min(blocks.count() ** 2, max(2000, int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    side = lambda name: blocks.select(F.col(kind).alias(name), F.col("__keys").alias(f"__{name}"))
    more = [c for c in met.columns if c not in (left, right)]
    both = met.join(side(left), left).join(side(right), right).select(f"__{left}", f"__{right}", *more).repartition(parts)
    return both.select(F.explode(f"__{left}").alias(left), f"__{right}", *more).select(left, F.explode(f"__{right}").alias(right), *more)
