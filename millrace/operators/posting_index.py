"""Lexical recall by postings: character n-grams of titles and contents and whole tags, in a table dealt out by term.

Posts are numbered in order of freshness: segments of a bounded number of posts, the freshest first, and places within a segment. The
postings of a term in a segment are rising places, cut into blocks of at most 1,024, each with its first and last place and
the differences between in variable-length bytes. The table is partitioned by a hash of the term, so that a query reads the folders of
its own terms alone, and sorted by term inside, so that a file's statistics leave out the rest.

A term of at least three characters can only be in a text that has all its trigrams (shorter ones have a posting of their own), so
postings bound how many terms a post matches. Posts are taken in order of that bound and of freshness, some of each route; their texts
decide what they match in truth. A route ends as soon as as many posts as wanted come before everything that has not been
looked at; until then twice as many are taken. So the result is that of the scan, ``recall.lexical``, whatever the query and the filters.

Defined cases: null texts, tags and dates as in the scan; a query without terms finds nothing; an empty table gives an empty index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import recall

FIELDS = ("title", "content", "tags")
LARGEST, BLOCK = 3, 1024
_POSTINGS = "bucket int, field string, term string, segment int, first int, last int, n int, deltas binary"
_BOUNDS = "segment int, place int, in_title int, in_content int, in_tags int"


def packed(places: np.ndarray) -> bytes:
    """Rising numbers as differences in bytes of seven bits, the last of each with its high bit clear."""
    d = np.diff(places, prepend=places[:1]).astype(np.uint64)
    out = bytearray()
    if len(d) and d.max() < 128:
        return d.astype(np.uint8).tobytes()
    for x in d.tolist():
        while x >= 128:
            out.append(x & 127 | 128)
            x >>= 7
        out.append(x)
    return bytes(out)


def unpacked(first: int, deltas: bytes) -> np.ndarray:
    raw = np.frombuffer(deltas, np.uint8)
    ends = raw < 128
    if ends.all():
        return first + np.cumsum(raw, dtype=np.int64)
    stop = np.flatnonzero(ends)
    start = np.concatenate(([0], stop[:-1] + 1))
    shift = np.arange(len(raw)) - np.repeat(start, stop - start + 1)
    return first + np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << (7 * shift), start))


def grams(texts: Sequence[str], most_bits: int = 62) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of an n-gram of one to three characters and the number of the text that holds it, by n-gram.

    Characters are numbered among those that are there, so that an n-gram and its text are one number of ``most_bits`` bits, and sorting is that of numbers; with
    too many kinds of characters for that, the two are sorted as they are.
    """
    point = np.frombuffer("\0\0\0".join([*texts, ""]).encode("utf-32-le"), "<u4").astype(np.int64)
    if len(point) < LARGEST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = np.zeros(0x110000, bool)
    there[point] = True
    there[0] = True
    signs, place = np.flatnonzero(there), np.cumsum(there) - 1
    of = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    bits, low = int(len(signs)).bit_length(), len(texts).bit_length()
    narrow = LARGEST * bits + low <= most_bits
    width = bits if narrow else 21
    drawn, found = place[point] if narrow else point, []
    for n in range(1, LARGEST + 1):
        shifted = [drawn[i : len(drawn) - LARGEST + 1 + i] for i in range(n)]
        whole = np.logical_and.reduce([c > 0 for c in shifted])  # within one text
        # Three characters of one width, 21 bits if they are not numbered; shorter n-grams end in zeros.
        code = sum((c << (width * (LARGEST - 1 - i)) for i, c in enumerate(shifted)), np.zeros(1, np.int64))[whole]
        text = of[: len(whole)][whole]
        found.append(code << low | text if narrow else np.stack((code, text)))
    if narrow:
        both = np.sort(np.concatenate(found))
        both = both[np.diff(both, prepend=-1) != 0]
        code, text = both >> low, both & ((1 << low) - 1)
        part = lambda i: signs[code >> (width * (LARGEST - 1 - i)) & ((1 << width) - 1)]
        return sum((part(i) << (42 - 21 * i) for i in range(LARGEST)), np.zeros(1, np.int64)), text
    code, text = np.concatenate(found, axis=1)
    order = np.lexsort((text, code))
    code, text = code[order], text[order]
    once = np.ones(len(code), bool)
    once[1:] = (np.diff(code) != 0) | (np.diff(text) != 0)
    return code[once], text[once]


def spelled(codes: np.ndarray) -> list[str]:
    points = np.stack([(codes >> (42 - 21 * i)) & 0x1FFFFF for i in range(LARGEST)], axis=1).astype("<u4")
    return np.ascontiguousarray(points).view(f"<U{LARGEST}").ravel().tolist()


def _posted(batches: Iterator[pa.RecordBatch], chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The places of each n-gram in some posts of a segment: rows of lists, to be put together by term."""
    for batch in batches:
        if not len(batch):
            continue
        segments, places = batch.column("segment").to_numpy(), batch.column("place").to_numpy()
        for field in ("title", "content"):
            texts = [t or "" for t in batch.column(field).to_pylist()]
            ends = np.cumsum([len(t) for t in texts])
            cut = np.concatenate(([0], np.flatnonzero((np.diff(ends // chars, prepend=0) != 0) | (np.diff(segments, prepend=segments[0]) != 0)), [len(texts)]))
            for start, stop in zip(cut, cut[1:], strict=False):
                code, at = grams(texts[start:stop])
                if not len(code):
                    continue
                first = np.flatnonzero(np.diff(code, prepend=-1))
                offsets = np.append(first, len(code)).astype(np.int32)
                terms = spelled(code[first])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places[start:stop][at].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([field] * len(terms)), pa.array(terms), pa.array(np.full(len(terms), segments[start], np.int32)), lists], ["field", "term", "segment", "places"])


def needed(term: str) -> list[str]:
    """The n-grams without which a text cannot hold the term; none for a term of no other characters than the code point 0."""
    parts = [p for p in term.lower().split("\0") if p]
    return sorted({p[i : i + min(LARGEST, len(p))] for p in parts for i in range(len(p) - min(LARGEST, len(p)) + 1)})


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """``docs`` (segment, place, id) and ``postings``, in folders below ``path``."""

    path: str
    docs: DataFrame
    postings: DataFrame
    buckets: int

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        postings = spark.read.schema(_POSTINGS).parquet(f"{path}/postings")
        docs = spark.read.schema("segment int, place int, id long").parquet(f"{path}/docs")
        return Index(path, docs, postings, spark.read.schema("buckets int").json(f"{path}/layout").first()[0])

    def rows(self, terms: dict[str, Sequence[str]]) -> DataFrame:
        """The postings of terms by field, out of their buckets alone."""
        spark = self.postings.sparkSession
        wanted = [(f, t) for f, names in terms.items() for t in names]
        if not wanted:
            return self.postings.limit(0)
        found = spark.createDataFrame(wanted, "field string, term string").withColumn("bucket", _bucket(F.col("term"), self.buckets)).collect()  # a query's terms
        cond = F.lit(False)
        for field in terms:
            names = [r["term"] for r in found if r["field"] == field]
            cond = cond | ((F.col("field") == field) & F.col("term").isin(names))
        return self.postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in found})) & F.col("term").isin(sorted({r["term"] for r in found})) & cond)


def build(posts: DataFrame, path: str, segment_rows: int = 50_000, buckets: int = 64) -> Index:
    """Write the index of ``posts`` (id, title, content, tags, updated_at)."""
    spark = posts.sparkSession
    segments = posts.count() // segment_rows + 1
    order = (F.desc_nulls_last("updated_at"), F.desc("id"))
    ranged = posts.select("id", "title", "content", "tags", "updated_at").repartitionByRange(segments, *order).sortWithinPartitions(*order)
    # A row's number has its partition in the high bits and its place there in the low 33.
    number = F.monotonically_increasing_id()
    placed = ranged.withColumn("__n", number).select(F.shiftright("__n", 33).cast("int").alias("segment"), F.col("__n").bitwiseAND(F.lit((1 << 33) - 1)).cast("int").alias("place"), "id", "title", "content", "tags")
    placed.write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.schema(placed.schema).parquet(f"{path}/texts")
    texts.select("segment", "place", "id").write.mode("overwrite").parquet(f"{path}/docs")
    lowered = texts.select("segment", "place", F.lower("title").alias("title"), F.lower("content").alias("content"))
    words = lowered.mapInArrow(_posted, "field string, term string, segment int, places array<int>")
    tags = texts.select(F.lit("tags").alias("field"), F.explode(F.array_compact(F.array_distinct("tags"))).alias("term"), "segment", F.array("place").alias("places"))
    # A term has at most a segment's posts in one group.
    lists = words.unionByName(tags).groupBy("field", "term", "segment").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    coded = lists.withColumn("bucket", _bucket(F.col("term"), buckets)).mapInArrow(_coded, _POSTINGS)
    spread = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    coded.repartition(spread, "bucket", "segment").sortWithinPartitions("bucket", "field", "term", "segment", "first").write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/postings")
    spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").json(f"{path}/layout")
    return Index.read(spark, path)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("bucket", "field", "term", "segment", "first", "last", "n", "deltas")}
        flat, offsets = batch.column("places").values.to_numpy(), batch.column("places").offsets.to_numpy()
        names = {c: batch.column(c).to_pylist() for c in ("bucket", "field", "term", "segment")}
        for row in range(len(batch)):
            for at in range(offsets[row], offsets[row + 1], BLOCK):
                places = flat[at : min(at + BLOCK, offsets[row + 1])]
                for c, values in names.items():
                    out[c].append(values[row])
                out["first"].append(int(places[0]))
                out["last"].append(int(places[-1]))
                out["n"].append(len(places))
                out["deltas"].append(packed(places))
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _bounds(table: pa.Table, words: Sequence[str], tags: Sequence[str], most: int) -> pa.Table:
    """Of one segment's postings: at most how many terms its posts match, for the first ``most`` posts of each route."""
    places: dict[tuple[str, str], list[np.ndarray]] = {}
    for row in table.select(["field", "term", "first", "deltas"]).to_pylist():
        places.setdefault((row["field"], row["term"]), []).append(unpacked(row["first"], row["deltas"]))
    none = np.zeros(0, np.int64)
    own = {key: np.unique(np.concatenate(parts)) for key, parts in places.items()}
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for field, terms in (("title", words), ("content", words), ("tags", tags)):
        met = [none]
        for term in terms:
            names = needed(term) if field != "tags" else [term]
            lists = sorted((own.get((field, g), none) for g in names), key=len)
            both = lists[0] if lists else none
            for other in lists[1:]:  # the shortest first
                both = both[np.isin(both, other, assume_unique=True)]
            met.append(both)
        counts[field] = np.unique(np.concatenate(met), return_counts=True)
    chosen = none
    for at, n in counts.values():
        chosen = np.union1d(chosen, at[np.lexsort((at, -n))[:most]])
    of = lambda at, n: np.concatenate((n, [0]))[np.where(np.isin(chosen, at), np.searchsorted(at, chosen), len(n))].astype(np.int32)
    segment = np.full(len(chosen), table.column("segment")[0].as_py() if len(table) else 0, np.int32)
    return pa.table([pa.array(segment), pa.array(chosen.astype(np.int32)), *(pa.array(of(*counts[f])) for f in FIELDS)], names=["segment", "place", "in_title", "in_content", "in_tags"])


def lexical_routes(index: Index, posts: DataFrame, words: Sequence[str], tags: Sequence[str], filters: recall.Filters, scan: int) -> DataFrame:
    """The same rows as ``recall.lexical_routes`` over the posts of the index."""
    words, tags = list(words), list(tags)
    if not all(needed(t) for t in words):
        return recall.lexical_routes(posts, words, tags, filters, scan)  # such a term may be anywhere
    grams = sorted({g for t in words for g in needed(t)})
    rows = index.rows({"title": grams, "content": grams, "tags": sorted({t for t in tags if t is not None})})
    routes = ("in_title", "in_content", "in_tags")
    bounded = lambda most: lambda table: _bounds(table, words, tags, most)
    cut = 2 * scan
    while True:
        bounds = rows.groupBy("segment").applyInArrow(bounded(cut), _BOUNDS)
        first = {c: bounds.where(F.col(c) > 0).orderBy(F.desc(c), "segment", "place").limit(cut) for c in routes}
        every = first["in_title"].select("segment", "place").union(first["in_content"].select("segment", "place")).union(first["in_tags"].select("segment", "place")).distinct()
        # At most three times the cut.
        keys = index.docs.join(F.broadcast(every) if cut <= 4 * recall.MOST else every, ["segment", "place"])
        own = posts.where(filters.column()).join(F.broadcast(keys) if cut <= 4 * recall.MOST else keys, "id").select(
            "id", "source", "source_id", "updated_at", "latitude", "longitude", text.match_count(F.col("title"), words).alias("in_title"), text.match_count(F.col("content"), words).alias("in_content"),
            F.size(F.filter("tags", lambda t: t.isin(tags))).cast("double").alias("in_tags"), "segment", "place",
        ).persist()
        ends = [_ended(own, first[c], c, scan, cut) for c in routes]
        if all(ends):
            parts = [own.where(F.col(c) > 0).orderBy(F.desc(c), "segment", "place").limit(scan) for c in routes]
            return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().drop("segment", "place")
        own.unpersist()
        cut *= 4


def _ended(own: DataFrame, looked_at: DataFrame, route: str, scan: int, cut: int) -> bool:
    """Whether nothing that has not been looked at can be among a route's first."""
    seen = looked_at.select(F.count(F.lit(1)).alias("n"), F.max(F.struct((-F.col(route)).alias("bound"), "segment", "place")).alias("last")).first()
    if seen["n"] < cut:
        return True
    before = F.struct((-F.col(route)).cast("double").alias("bound"), "segment", "place") <= F.struct(F.lit(float(seen["last"]["bound"])).alias("bound"), F.lit(seen["last"]["segment"]).alias("segment"), F.lit(seen["last"]["place"]).alias("place"))
    return own.where((F.col(route) > 0) & before).limit(scan).count() >= scan


def lexical(index: Index, posts: DataFrame, words: Sequence[str], tags: Sequence[str], filters: recall.Filters, limit: int = 200, overfetch: float = 2.0) -> DataFrame:
    """The same rows and scores as ``recall.lexical`` over the posts of the index."""
    met = lexical_routes(index, posts, words, tags, filters, min(recall.MOST, max(limit, math.ceil(limit * overfetch))))
    return recall.score_lexical(met, words, tags, filters, limit)


def lexical_query(index: Index, posts: DataFrame, query: str, filters: recall.Filters, limit: int = 200, overfetch: float = 2.0) -> DataFrame:
    words, tags = text.query_terms(query)
    return lexical(index, posts, words, tags, filters, limit, overfetch)
