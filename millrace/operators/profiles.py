"""Creator profiles, upserts into tables without a table format, and incremental synchronisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import cleaning, vectors
from millrace.functions.cleaning import whole


def category_weights(posts: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Each owner's categories as shares of their categorised posts."""
    counts = posts.where(F.col("category").isNotNull()).groupBy(owner, "category").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(owner))
    return counts.withColumn("weight", F.round(F.col("n") / total, 6)).drop("n")


def tag_weights(posts: DataFrame, owner: str = "owner_id") -> DataFrame:
    """Each owner's tags as shares of their posts; a post counts a tag once."""
    totals = posts.groupBy(owner).agg(F.count(F.lit(1)).alias("posts"))
    tags = posts.select(owner, F.explode(F.array_distinct("tags")).alias("tag")).groupBy(owner, "tag").agg(F.count(F.lit(1)).alias("n"))
    return tags.join(totals, owner).withColumn("weight", F.round(F.col("n") / F.col("posts"), 6)).drop("n", "posts")


def _as_list(weights: DataFrame, owner: str, key: str, name: str) -> DataFrame:
    return weights.groupBy(owner).agg(F.array_sort(F.collect_list(F.struct(key, "weight"))).alias(name))


def creator_profiles(users: DataFrame, posts: DataFrame, owner: str = "owner_id") -> DataFrame:
    """A row a user, with or without posts: counts, means over cleaned values, the last post, and weights."""
    stats = posts.groupBy(owner).agg(
        F.count(F.lit(1)).alias("authored_post_count"), *(F.avg(whole(F.col(c))).alias(f"avg_{c}") for c in ("likes", "views", "marks", "dislikes")),
        F.avg(F.when(F.col("ratescore") >= 0, F.col("ratescore"))).alias("avg_rate_score"), F.max("created_at").alias("last_authored_at"),
    )
    cats, tags = _as_list(category_weights(posts, owner), owner, "category", "category_weights"), _as_list(tag_weights(posts, owner), owner, "tag", "tag_weights")
    joined = users.join(stats, owner, "left").join(cats, owner, "left").join(tags, owner, "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("authored_post_count", "avg_likes", "avg_views", "avg_marks", "avg_dislikes")}
    empty = {c: F.coalesce(F.col(c), F.array().cast(joined.schema[c].dataType)) for c in ("category_weights", "tag_weights")}
    return joined.withColumns(zeros | empty)


def profile_records(users: DataFrame, posts: DataFrame, source: str) -> DataFrame:
    """The stored record of each creator: what is known of the user without what names them, and what the posts say.

    ``users``: user_id, age, job, education, hobby, character, level, country, province, city, district, school. A user without an id
    is an error.
    """
    key = F.col("user_id").cast("string")
    kept = users.select(
        F.when(key.isNull(), F.raise_error(F.lit("a user needs an id")).cast("string")).otherwise(key).alias("owner_id"), cleaning.age_bucket(F.col("age")).alias("age_bucket"),
        *(cleaning.optional_text(F.col(c)).alias(c) for c in ("job", "education")), cleaning.multi_value(F.col("hobby")).alias("hobby_tags"), cleaning.optional_text(F.col("character")).alias("character_tag"),
        F.col("level").alias("user_level"), *(cleaning.optional_text(F.col(c)).alias(c) for c in ("country", "province", "city", "district", "school")),
    )
    made = creator_profiles(kept, posts)
    return made.withColumnRenamed("owner_id", "source_user_id").withColumns({"source": F.lit(source), "profile_version": F.lit(1), "source_updated_at": F.col("last_authored_at")})


def sync_profiles(new: DataFrame, old: DataFrame | None, write, dry_run: bool = False) -> dict[str, int]:
    """Merge profiles into those that are stored; with ``dry_run`` only count. ``write`` stores the merged table."""
    total, ids = new.agg(F.count(F.lit(1)), F.countDistinct("source", "source_user_id")).first()
    if total != ids:
        raise RuntimeError("a user has two profiles")
    keys = ["source", "source_user_id"]
    known = 0 if old is None else new.join(old.select(*keys), keys, "left_semi").count()
    if not dry_run:
        write(new if old is None else upsert(old, new, keys, [c for c in new.columns if c not in keys]))
    return {"profiles": total, "new": total - known, "changed": known, "written": 0 if dry_run else total}


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str], derived: str | None = None, depends: Sequence[str] = ()) -> DataFrame:
    """The merge of two versions of a table: new rows win; a derived column is emptied where what it depends on has changed."""
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    both = o.join(n, same, "full_outer")
    fresh = F.col("n.__new").isNotNull()
    cols = [F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in (*keys, *values)]
    if derived:
        kept = F.col("o.__old").isNotNull()
        for c in depends:
            kept = kept & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
        cols.append(F.when(~fresh | kept, F.col(f"o.{derived}")).alias(derived))
    return both.select(*cols)


def backfill(old: DataFrame, new: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Values for rows that have none; a value that is there is never overwritten."""
    return old.join(new.withColumnRenamed(column, "__new"), list(keys), "left").withColumn(column, F.coalesce(column, "__new")).drop("__new")


def encode_missing(rows: DataFrame, encode, key: str, column: str, size: int, limit: int | None = None) -> DataFrame:
    """``rows`` with ``column`` filled where it was null, by ``encode`` (key, text to key, vector), for at most ``limit`` of them in order of the key.

    Encoded vectors are checked (one a row, of ``size``, finite, of length 1), and that nothing else has changed: the null ones that
    are left are those there were less those encoded, else it is an error.
    """
    missing = rows.where(F.col(column).isNull()).select(key, "text").orderBy(key)
    missing = missing if limit is None else missing.limit(limit)
    made = encode(missing).select(key, F.col("vector").cast(T.ArrayType(rows.schema[column].dataType.elementType, True)).alias(column))
    before, wanted = rows.where(F.col(column).isNull()).count(), missing.count()
    bad, found = made.agg(F.count_if(~vectors.is_unit(F.col(column), size)), F.countDistinct(key)).first()
    if bad or found != wanted:
        raise RuntimeError(f"{bad} encoded vectors are not of length 1 and size {size}, and {found} of {wanted} rows have one")
    out = backfill(rows, made, [key], column)
    after = out.where(F.col(column).isNull()).count()
    if after != before - wanted:
        raise RuntimeError(f"{after} rows are still without a vector instead of {before - wanted}")
    return out


def sync_summary(posts: DataFrame, by: Sequence[str]) -> DataFrame:
    number = F.col("source_id").try_cast("long")
    return posts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("ids"), F.min(number).alias("least"), F.max(number).alias("most"), F.count("ratescore").alias("rated")
    )
