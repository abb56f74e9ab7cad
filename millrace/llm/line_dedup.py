"""Exact line deduplication that returns keep bitmaps instead of text.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at either end and with A-Z lower-cased. Keys of at least
``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the document with the
largest id. Only DataFrame operations are used.

Plan: every line's key becomes a pair of 64-bit hashes, written once to the shared folder. The occurrences are range-partitioned by
(hashes, document), so a key that a third of all documents hold is spread over as many partitions as its
size asks for, and sorted by position within, so each document's occurrences of a key stand side by side: the first of
them streams on and the others stop there, without a row that gathers them. Numbers of holders are partial sums of these
first occurrences, merged in one small shuffle. The keys over the limit meet the written occurrences again, whose
documents and positions become run-length bitmaps. Where the bitmaps are measured to be small they are sent to the
texts; else both are shuffled by document.

Defined cases: null or empty text is one empty line; a null id counts as one document smaller than all others; rows that
repeat an id count as one document and all rows of the keeping id keep their lines; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import fewer, written

SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(SPACE)), _UPPER, _LOWER)


def keep_bitmaps(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per distinct (id, text) that loses lines: ``doc, text_hash, n_dropped, drop_runs``.

    ``drop_runs`` is the document's keep bitmap, run-length encoded: the (start, len) of each run of dropped lines in
    order; all other lines are kept.
    """
    key = line_key(F.col("line"))
    lines = (
        docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
        .select("doc", F.xxhash64("text").alias("text_hash"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .withColumn("key", key)
        .where(F.length("key") >= min_chars)
        .select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    lines = written(lines, "lines")
    spread = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "text_hash", "pos")
    nth = F.row_number().over(Window.partitionBy("h1", "h2", "doc").orderBy("text_hash", "pos"))
    first = spread.select("h1", "h2", "doc", nth.alias("nth")).where("nth = 1")
    common = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("holders"), F.max("doc").alias("keeper")).where(F.col("holders") >= min_docs)
    common = written(common, "common_lines")  # a plain scan: Spark broadcasts it if it is small, else it can split hot keys of the join
    lost = lines.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("keeper"))).select("doc", "text_hash", "pos")
    place = Window.partitionBy("doc", "text_hash").orderBy("pos")
    return (
        lost.distinct()
        .withColumn("island", F.col("pos") - F.row_number().over(place))
        .groupBy("doc", "text_hash", "island")
        .agg(F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("len"))
        .groupBy("doc", "text_hash")
        .agg(F.sum("len").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("start", "len"))).alias("drop_runs"))
    )


def kept_lines(lines: Column, drop_runs: Column) -> Column:
    """The lines that a keep bitmap keeps, in order; all of them where it is null."""

    def between(i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get(drop_runs, i - 1)["start"] + F.get(drop_runs, i - 1)["len"])
        end = F.when(i == F.size(drop_runs), F.size(lines)).otherwise(F.get(drop_runs, i)["start"])
        return F.slice(lines, start + 1, end - start)

    return F.when(drop_runs.isNull(), lines).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drop_runs)), between)))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped`` added; every row of ``docs`` comes back once. Columns of these names are replaced.

    Bitmaps of up to ``broadcast_bytes`` go to the texts, so that no text is moved; beyond that both sides are shuffled.
    """
    docs = docs.drop("kept_text", "n_lines", "n_dropped")
    bitmaps = written(bitmaps, "bitmaps", fewer(docs.sparkSession))
    size = bitmaps.agg(F.sum(64 + 16 * F.size("drop_runs"))).first()[0] or 0
    own = docs.withColumns({"__doc": F.col(id_col).cast("long"), "__hash": F.xxhash64(F.col(text_col))})
    theirs = bitmaps.select(F.col("doc").alias("__doc2"), F.col("text_hash").alias("__hash2"), F.col("n_dropped").alias("__n"), F.col("drop_runs").alias("__runs"))
    both = own.join(theirs.hint("broadcast") if size <= broadcast_bytes else theirs.hint("merge"), F.col("__doc").eqNullSafe(F.col("__doc2")) & (F.col("__hash") == F.col("__hash2")), "left")
    return (
        both.withColumn("__lines", lines_of(F.col(text_col)))
        .withColumns({
            "kept_text": F.array_join(kept_lines(F.col("__lines"), F.col("__runs")), "\n"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dropped": F.coalesce("__n", F.lit(0)).cast("long"),
        })
        .drop("__doc", "__hash", "__doc2", "__hash2", "__n", "__runs", "__lines")
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept text and line counts: the bitmaps computed and applied."""
    ours = {k: v for k, v in options.items() if k in ("id_col", "text_col", "broadcast_bytes")}
    theirs = {k: v for k, v in options.items() if k != "broadcast_bytes"}
    return apply_bitmaps(docs, keep_bitmaps(docs, **theirs), **ours)
