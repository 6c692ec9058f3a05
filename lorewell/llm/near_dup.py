"""Groups of records whose word sets are similar, out of a table too large to compare pairwise.

A blocked sparse matrix product of the incidence of records and n-grams. Each record's words are ordered, rare
ones first. Columns are single words that at most ``RARE`` records hold, and 2-grams of the ordered words that
are more frequent. Two sets of Jaccard similarity ``t`` share at least ``c = t / (1 + t) * (n + m)`` words, so
their first common words lie within the first ``n - c + 2`` words of either; only the entries of that prefix
enter the product. Pairs whose first common word is rare meet in its column, all others in the column of their
first two common words: the search is exact, and a rare column is short whatever the size of the data.

The product is taken in blocks of columns (``blocks``). Of a pair's entries in a block the overlap that is
still possible is held against ``c``, as is the number of differing bits of two word bitmaps, which never
outnumber the differing words; the entries of the pairs that are left are counted and summed over the blocks.
For those the rest of the product, the columns beyond the prefix, is computed on their whole word sets.

Records with the same word set form a class and enter the product once, so groups of copies cost no pairs.
Sets of more than ``WIDE`` words would have too many 2-grams; a pair whose larger set is that wide meets in
columns of single words which only wide sets (and those within the similarity of one) fill.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm import blocks as B
from lorewell.llm import wordsets as W
from lorewell.operators.clusters import components
from lorewell.store import cut

THRESHOLD = 0.6
RARE = 256
WIDE = 256
#: Entries of a bucket.
BUCKET = 500_000
PLANES = 2  # 64-bit words of the bitmap
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _needed(n: np.ndarray, m: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of sets of these sizes with similarity ``t``."""
    return np.ceil((n.astype(np.float64) + m) * (t / (1 + t)) - W.EPS)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ (np.asarray(b, np.uint64) * _MIX)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _incidence(table: np.ndarray, t: float, buckets: int):
    def entries(rid: np.ndarray, values: np.ndarray, bounds: np.ndarray):
        n = np.diff(bounds)
        rec = np.repeat(np.arange(len(n)), n)
        h = values.astype(np.uint64)
        df = table[(h % np.uint64(W.CELLS)).astype(np.int64)]
        order = np.lexsort((h, df, rec))
        h, df = h[order], df[order]
        keys, recs, most = [], [], []
        need = np.ceil(n * t - W.EPS).astype(np.int64)  # the least overlap with any partner
        at = np.arange(len(h)) - np.repeat(bounds[:-1], n)
        size = np.repeat(n, n)
        left = np.repeat(n - need, n)
        # Rare words of the prefix as columns of their own.
        rare = (df <= RARE) & (at <= left)
        keys.append(mixed(h[rare], 1))
        recs.append(rec[rare])
        most.append((size - at)[rare])
        # Single words of wide sets.
        wide = (df > RARE) & (at <= left) & (size >= np.ceil(WIDE * t))
        # A set of which one common word is enough has no second one.
        wide |= (df > RARE) & (at <= left) & np.repeat(need < 2, n)
        keys.append(mixed(h[wide], 2))
        recs.append(rec[wide])
        most.append((size - at)[wide])
        # 2-grams of the frequent words of the prefix.
        first = np.minimum(np.searchsorted(np.flatnonzero(df > RARE), bounds[:-1]), 1 << 62)
        frequent = np.flatnonzero(df > RARE)
        for k in np.flatnonzero((n <= WIDE) & (n >= 2)):
            end = bounds[k] + min(n[k], n[k] - need[k] + 2)
            mine = frequent[first[k] : first[k] + np.searchsorted(frequent[first[k] :], end)] if first[k] < len(frequent) else frequent[:0]
            if len(mine) < 2:
                continue
            i, j = _triangle(len(mine))
            keys.append(mixed(h[mine[i]], h[mine[j]]))
            recs.append(np.full(len(i), k))
            most.append(n[k] - (mine[j] - bounds[k]) + 1)
        key, rec_, most_ = np.concatenate(keys), np.concatenate(recs), np.concatenate(most)
        plane = np.zeros((len(n), PLANES), np.uint64)
        bit = (h % np.uint64(64 * PLANES)).astype(np.int64)
        np.bitwise_or.at(plane, (rec, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        return bucket, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), rec_, most_, B.Records(rid, n, plane)

    return entries


_triangles: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _triangle(k: int) -> tuple[np.ndarray, np.ndarray]:
    if k not in _triangles:
        _triangles[k] = np.triu_indices(k, 1)
    return _triangles[k]


def _bounds(t: float):
    def fits(l: B.Entries, r: B.Entries, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = l.rec[x], r.rec[y]
        n, m = l.records.size[a], r.records.size[b]
        ok = np.minimum(l.most[x], r.most[y]) >= _needed(n, m, t)
        ok &= np.minimum(n, m) >= np.maximum(n, m) * t - W.EPS
        at = np.flatnonzero(ok)
        differ = np.bitwise_count(l.records.plane[a[at]] ^ r.records.plane[b[at]]).sum(axis=1)
        ok[at] = differ <= (n[at].astype(np.float64) + m[at]) * ((1 - t) / (1 + t)) + W.EPS
        return ok

    def leads(e: B.Entries) -> np.ndarray:
        n = e.records.size[e.rec]
        return e.most >= _needed(n, n, t)

    return fits, leads


class NearDuplicates:
    """``classes`` (key, class_id, words), ``members`` (id, key) and ``pairs`` (class_a, class_b, similarity).

    Records without any word form no class and are similar to nothing; null texts count as empty; rows that repeat
    an id count once each, by their texts; a null id is dropped. Other columns of the input do not matter.
    """

    def __init__(self, records: DataFrame, id_col: str, texts: list[Column], threshold: float = THRESHOLD, bucket: int = BUCKET, part: int = B.PART):
        self.threshold, self.bucket, self.part = threshold, bucket, part
        sets = records.select(F.col(id_col).cast("string").alias("id"), F.array_sort(W.words(*texts)).alias("words")).where("id is not null and size(words) > 0")
        rows = cut(sets.select("*", W.set_key("words").alias("key")), "near-rows")
        self.members = rows.select("id", "key").distinct()
        self.classes = cut(rows.groupBy("key").agg(F.min("id").alias("class_id"), F.first("words").alias("words")), "near-classes")
        self.pairs = cut(self._pairs(), "near-pairs")

    def _pairs(self) -> DataFrame:
        t = self.threshold
        # The 64-bit name only finds a class again; names that clash bring both classes to the check.
        named = self.classes.select(F.xxhash64("class_id").alias("rid"), "class_id", "words")
        hashed = named.select("rid", W.hashes("words").alias("hs"))
        table = W.frequencies(hashed)
        buckets = max(1, -(-int(table.sum(dtype=np.int64)) // self.bucket))
        fits, leads = _bounds(t)
        incidence = B.chunks(hashed, _incidence(table, t, buckets))
        met = B.product(incidence, None, fits, leads, self.part).groupBy("a", "b").agg(F.sum("shared").alias("shared"))
        x = named.select(F.col("rid").alias("a"), F.col("class_id").alias("class_a"), F.col("words").alias("wa"))
        y = named.select(F.col("rid").alias("b"), F.col("class_id").alias("class_b"), F.col("words").alias("wb"))
        checked = met.join(x, "a").join(y, "b").where("class_a <> class_b").withColumn("similarity", W.jaccard(F.col("wa"), F.col("wb")))
        return checked.where(F.col("similarity") >= t - W.EPS).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "similarity").distinct()

    def membership(self) -> DataFrame:
        """(id, class_id) of every record that has a word."""
        return self.members.join(self.classes.select("key", "class_id"), "key").select("id", "class_id")

    def all_pairs(self) -> DataFrame:
        """(id_a, id_b, similarity), smaller id first: pairs of records, copies included."""
        m = cut(self.membership(), "near-membership")
        a, b = m.select(F.col("id").alias("x"), F.col("class_id").alias("class_a")), m.select(F.col("id").alias("y"), F.col("class_id").alias("class_b"))
        across = self.pairs.join(a, "class_a").join(b, "class_b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")
        same = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), F.lit(1.0).alias("similarity"))
        return across.unionByName(same)

    def linked(self) -> DataFrame:
        """One row per record: id, class_id, copies (records of the class) and links (similar classes)."""
        ends = self.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
        links = ends.groupBy("class_id").agg(F.count("*").alias("links"))
        m = self.membership()
        copies = m.groupBy("class_id").agg(F.count("*").alias("copies"))
        return m.join(copies, "class_id").join(links, "class_id", "left").select("id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))

    def groups(self) -> DataFrame:
        """(id, class_id, group_id): every record with the smallest class of those it is linked to over any number of links."""
        found = components(self.pairs, "class_a", "class_b").select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
        return self.membership().join(found, "class_id", "left").select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def experience_texts() -> list[Column]:
    return [F.col("title"), F.col("problem"), F.col("recommendation")]
