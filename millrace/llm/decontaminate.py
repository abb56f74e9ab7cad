"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

Words are runs of letters and digits after A-Z are lower-cased. Every run of ``window`` item words is one item window; an
item with fewer words is one window of its own. A window is contained in a document where its words stand there in a row.

Plan: a window is the set of its shingles of ``shingle`` words (windows with fewer words: their single words). All of
them have to be in the document, so one is a necessary prefix; the rarest is chosen, by its number of occurrences over
all documents. Document shingles meet these prefix shingles in a join on their hash; a match fixes where the window has
to start, so the length and positional bounds drop starts outside the document, and what is left is verified word by
word. The benchmark's prefixes are broadcast only up to ``broadcast_rows`` rows; beyond, the join shuffles hashes and
positions alone and verified rows fetch their documents afterwards.

Defined cases: null or wordless documents have no words and no hits; null or wordless items have no windows; a null item
id counts as one item but is left out of the digest; rows that repeat a document id with another text are told apart;
empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text; none of null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _NOT_WORD, -1), "")


def _grams(words: Column, n: int) -> Column:
    """The hash of the n words from each position on; as many as fit."""
    count = F.size(words) - (n - 1)
    hashed = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(count > 0, hashed).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, *, id_col: str, text_col: str, window: int) -> DataFrame:
    """``item, win`` (words): every window of every item."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    return words.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, window))).alias("win")).distinct()


def find_windows(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 13, shingle: int = 3, broadcast_rows: int = 500_000,
) -> DataFrame:
    """``doc, text_hash, start, len, item``: every occurrence of an item window, verified word by word."""
    wins = item_windows(items, id_col=item_id, text_col=item_text, window=window)
    # (win_id, size of its shingles, their hash, where in the window)
    sized = wins.select("item", "win", F.xxhash64("item", "win").alias("win_id"), F.when(F.size("win") >= shingle, shingle).otherwise(1).alias("n"))
    parts = sized.select(
        "item", "win", "win_id", "n",
        F.posexplode(F.when(F.col("n") == shingle, _grams(F.col("win"), shingle)).otherwise(_grams(F.col("win"), 1))).alias("at", "gram"),
    )
    grams = parts.select("n", "gram").distinct()
    by_size = {r["n"]: r["rows"] for r in grams.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}
    small = sum(by_size.values()) <= broadcast_rows and wins.count() <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)

    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))

    def doc_grams(n: int, *cols: str) -> DataFrame:
        return texts.select(*cols, F.posexplode(_grams(F.col("words"), n)).alias("pos", "gram"))

    counted = None
    for n in by_size:
        one = doc_grams(n).join(near(grams.where(F.col("n") == n)), "gram").groupBy("n", "gram").agg(F.count(F.lit(1)).alias("seen"))
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        return texts.select("doc", "text_hash", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("item")).where(F.lit(False))
    rarest = (
        parts.join(counted, ["n", "gram"], "left")
        .groupBy("item", "win_id", "n")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "gram", "at", "win")).alias("least"))
        .where(F.col("least.seen") > 0)
        .select("item", "n", "least.gram", "least.at", "least.win", F.size("least.win").alias("len"))
    )
    found = None
    for n in by_size:
        prefixes = rarest.where(F.col("n") == n).drop("n")
        if small:
            met = doc_grams(n, "doc", "text_hash", "words").join(F.broadcast(prefixes), "gram")
        else:
            whole = texts.distinct().select(F.col("doc").alias("__doc"), F.col("text_hash").alias("__hash"), "words")
            met = doc_grams(n, "doc", "text_hash").join(prefixes, "gram")
            met = met.join(whole, F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("text_hash") == F.col("__hash")))
        start = F.col("pos") - F.col("at")
        one = (
            met.where((start >= 0) & (start + F.col("len") <= F.size("words")))
            .where(F.slice("words", start + 1, F.col("len")) == F.col("win"))
            .select("doc", "text_hash", start.alias("start"), "len", "item")
        )
        found = one if found is None else found.unionByName(one)
    return found


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_share: int = 20, **options) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, item_ids`` (sorted as strings) and ``contaminated``.

    A document is contaminated if it has hit words and ``min_share`` times their number is at least that of its words.
    """
    found = written(find_windows(docs.select(id_col, text_col), items, id_col=id_col, text_col=text_col, **options).distinct(), "window_hits")
    spans = found.select("doc", "text_hash", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy("doc", "text_hash").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    hit = (
        spans.withColumn("from", F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0))))
        .groupBy("doc", "text_hash").agg(F.sum(F.greatest(F.col("end") - F.col("from"), F.lit(0))).cast("long").alias("__hit"))
    )
    of = found.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("__items"), F.countDistinct(F.struct("item")).cast("long").alias("__n_items"))
    both = hit.join(of, (hit["doc"].eqNullSafe(of["doc"])) & (hit["text_hash"] == of["text_hash"])).select(
        hit["doc"].alias("__doc"), hit["text_hash"].alias("__text_hash"), "__hit", "__items", "__n_items"
    )
    own = docs.withColumns({"n_words": F.size(words_of(F.col(text_col))).cast("long"), "__hash": F.xxhash64(F.col(text_col))})
    return (
        own.join(both, F.col(id_col).eqNullSafe(F.col("__doc")) & (F.col("__hash") == F.col("__text_hash")), "left")
        .withColumns({
            "n_hit": F.coalesce("__hit", F.lit(0)).cast("long"),
            "n_items": F.coalesce("__n_items", F.lit(0)).cast("long"),
            "item_ids": F.coalesce("__items", F.array().cast("array<string>")),
        })
        .withColumn("contaminated", (F.col("n_hit") > 0) & (min_share * F.col("n_hit") >= F.col("n_words")))
        .drop("__hash", "__doc", "__text_hash", "__hit", "__items", "__n_items")
    )
