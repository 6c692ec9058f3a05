"""Evaluation passages inside training text, found with suffix arrays of the training text.

The corpus is cut into shards of about ``SHARD`` words, whole documents each. A shard is stored as one row: the
words as numbers (ranks of their 64-bit hashes), and its suffix array, the positions of all words in the order
of everything that follows them up to the document's end. The index is written once and can be opened again for
any number of evaluation sets; it does not depend on them.

Every suffix of every evaluation item is looked up by binary search, word by word: the interval of the array that
agrees so far is narrowed until it is empty. The interval at ``minimum`` words holds all places of a passage, and
the depth reached is the longest verbatim match. Places are expanded from intervals in steps of bounded size; a
place whose preceding word agrees too belongs to a passage that began before it, so each passage comes out once.

The evaluation set is sent to the executors in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast
has a fixed bound; a larger set takes more passes over the index. There is no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.store import folder

MINIMUM = 12
SHARD = 250_000
BLOCK_WORDS = 2_000_000
STEP = 1_000_000
_TAG = re.compile(r"<[^<>]*>|\[[^\[\]]*\]")
_WORD = re.compile(r"[^\W_]+")
INDEX = "doc binary, start binary, word binary, code binary, suffix binary"
PASSAGES = "doc_id long, item_id long, doc_word int, item_word int, n_words int"


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, without tags, with character entities decoded."""
    if not text:
        return []
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


def hashed(texts: list[list[str]]) -> np.ndarray:
    """The 64-bit hashes of the words of all texts, one after another."""
    import xxhash

    number: dict[str, int] = {}
    at = np.fromiter((number.setdefault(w, len(number)) for ws in texts for w in ws), np.int64)
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))[at]


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """The positions of ``codes`` in the order of the suffixes that start there, by prefix doubling."""
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while n:
        both = rank * (n + 1)
        both[:-step] += rank[step:] + 1
        order = np.argsort(both, kind="stable")
        ahead = both[order]
        rank[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
        if rank[order[-1]] == n - 1 or step >= n:
            break
        step *= 2
    return order


class Shard:
    """Documents, their first positions, the sorted word hashes, the text in codes and its suffix array.

    A code is the rank of a word's hash from ``len(doc)`` on; below that are the ends of the documents, each its own.
    """

    def __init__(self, doc: np.ndarray, start: np.ndarray, word: np.ndarray, code: np.ndarray, suffix: np.ndarray):
        self.doc, self.start, self.word, self.code, self.suffix = doc, start, word, code, suffix

    @staticmethod
    def of(ids: list[int], texts: list[list[str]]) -> Shard:
        lengths = np.array([len(t) for t in texts], np.int64)
        word, rank = np.unique(hashed(texts), return_inverse=True)
        start = np.cumsum(lengths + 1) - lengths - 1
        code = np.empty(int((lengths + 1).sum()), np.int32)
        ends = start + lengths
        inside = np.ones(len(code), bool)
        inside[ends] = False
        code[ends], code[inside] = np.arange(len(ids)), rank + len(ids)
        return Shard(np.array(ids, np.int64), start, word, code, suffix_array(code).astype(np.int32))

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.doc, self.start, self.word, self.code, self.suffix)]

    @staticmethod
    def read(doc: bytes, start: bytes, word: bytes, code: bytes, suffix: bytes) -> Shard:
        kinds = (np.int64, np.int64, np.uint64, np.int32, np.int32)
        return Shard(*(np.frombuffer(x, k) for x, k in zip((doc, start, word, code, suffix), kinds, strict=True)))

    def _edge(self, low: np.ndarray, high: np.ndarray, depth: int, code: np.ndarray, after: bool) -> np.ndarray:
        """The first place in each interval whose word at ``depth`` is not below (``after``: is above) a code."""
        low, high = low.copy(), high.copy()
        n = len(self.code)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            at = self.suffix[np.minimum(mid, n - 1)].astype(np.int64) + depth
            there = np.where(at < n, self.code[np.minimum(at, n - 1)], -1)
            right = open_ & ((there <= code) if after else (there < code))
            low = np.where(right, mid + 1, low)
            high = np.where(open_ & ~right, mid, high)

    def search(self, text: np.ndarray, minimum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every position of ``text`` (hashes; 0 ends an item) that starts a match of ``minimum`` words: itself, its interval, and the longest match."""
        at = np.searchsorted(self.word, text)
        known = (at < len(self.word)) & (self.word[np.minimum(at, len(self.word) - 1)] == text) & (text != 0) if len(self.word) else np.zeros(len(text), bool)
        code = np.append(np.where(known, at + len(self.doc), -1), -1)
        query = np.flatnonzero(known)
        low, high = np.zeros(len(query), np.int64), np.full(len(query), len(self.code), np.int64)
        longest = np.zeros(len(text), np.int32)
        first = last = np.zeros(0, np.int64)
        found, depth = np.zeros(0, np.int64), 0
        while len(query):
            want = code[np.minimum(query + depth, len(text))]
            live = want >= 0
            query, low, high, want = query[live], low[live], high[live], want[live]
            low, high = self._edge(low, high, depth, want, False), self._edge(low, high, depth, want, True)
            live = low < high
            query, low, high = query[live], low[live], high[live]
            depth += 1
            longest[query] = depth
            if depth == minimum:
                found, first, last = query, low, high
        return found, first, last, longest[found]

    def passages(self, text: np.ndarray, minimum: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the shard, place in ``text``, words) of every maximal match, in steps."""
        query, low, high, longest = self.search(text, minimum)
        hashes = np.append(self.word, 0)
        total = np.concatenate([[0], np.cumsum(high - low)])
        for begin in range(0, int(total[-1]), STEP):
            span = np.arange(begin, min(begin + STEP, int(total[-1])))
            k = np.searchsorted(total, span, "right") - 1
            p, q, most = self.suffix[low[k] + span - total[k]].astype(np.int64), query[k], longest[k]
            before = np.where((p > 0) & (q > 0), self.code[np.maximum(p - 1, 0)].astype(np.int64) - len(self.doc), -1)
            same = (before >= 0) & (hashes[before] == text[np.maximum(q - 1, 0)])
            p, q, most = p[~same], q[~same], most[~same]
            n = np.full(len(p), minimum)
            growing = np.flatnonzero(n < most)
            while len(growing):
                there = self.code[p[growing] + n[growing]].astype(np.int64) - len(self.doc)
                ok = (there >= 0) & (hashes[there] == text[q[growing] + n[growing]])
                growing = growing[ok]
                n[growing] += 1
                growing = growing[n[growing] < most[growing]]
            yield p, q, n


class SuffixIndex:
    """The stored suffix arrays of a corpus."""

    def __init__(self, spark: SparkSession, path: str):
        self.shards = spark.read.schema(INDEX).parquet(path)
        self.path = path

    @staticmethod
    def build(documents: DataFrame, path: str | None = None, shard: int = SHARD) -> SuffixIndex:
        """Writes the index of (doc_id, text). Null and empty texts are left out; repeated rows are documents of their own."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[int] = []
            texts: list[list[str]] = []
            size = 0

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in Shard.of(ids, texts).row()], names=[c.split()[0] for c in INDEX.split(", ")])

            for b in batches:
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    ws = words(t)
                    if not ws or i is None:
                        continue
                    ids.append(i)
                    texts.append(ws)
                    size += len(ws)
                    if size >= shard:
                        yield flush()
                        ids, texts, size = [], [], 0
            if ids:
                yield flush()

        spark = documents.sparkSession
        path = path or folder(spark, "suffixes")
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, INDEX).write.parquet(path)
        return SuffixIndex(spark, path)

    def leaks(self, eval_items: DataFrame, minimum: int = MINIMUM) -> DataFrame:
        """(doc_id, item_id, doc_word, item_word, n_words): every maximal passage of at least ``minimum`` words.

        A passage that occurs several times gives several rows. Items that are null or shorter are in no document;
        an empty evaluation set finds nothing; other columns do not matter.
        """

        def tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"item_id": b["item_id"], "ws": [hashed([words(t)]).astype(np.int64) for t in b["text"]]})

        items = eval_items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null")
        items = items.mapInPandas(tokenised, "item_id long, ws array<long>").where(F.size("ws") >= minimum)
        out, ids, held, size = None, [], [], 0

        def pass_over() -> DataFrame:
            found = self.shards.mapInPandas(_scan(np.array(ids, np.int64), held, minimum), PASSAGES)
            return found if out is None else out.unionByName(found)

        # Items stream through the driver as numbers, block by block; a block is bounded, and so is what a task carries.
        for row in items.toLocalIterator():
            if held and size + len(row["ws"]) > BLOCK_WORDS:
                out = pass_over()
                ids, held, size = [], [], 0
            ids.append(row["item_id"])
            held.append(np.array(row["ws"], np.int64))
            size += len(row["ws"])
        return pass_over()


def _scan(item_ids: np.ndarray, items: list[np.ndarray], minimum: int):
    lengths = np.array([len(x) for x in items], np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()), np.uint64)
    for s, x in zip(start, items, strict=True):
        text[s : s + len(x)] = x.astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                shard = Shard.read(*row)
                for p, q, n in shard.passages(text, minimum):
                    d, i = np.searchsorted(shard.start, p, "right") - 1, np.searchsorted(start, q, "right") - 1
                    yield pd.DataFrame({"doc_id": shard.doc[d], "item_id": item_ids[i], "doc_word": p - shard.start[d], "item_word": q - start[i], "n_words": n})

    return run


def leaks(documents: DataFrame, eval_items: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """The passages of ``SuffixIndex.leaks`` with an index made for this call."""
    return SuffixIndex.build(documents).leaks(eval_items, minimum)


def leaked_items(documents: DataFrame, eval_items: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """(doc_id, item_id, passages, longest): one row per document and item it contains."""
    return leaks(documents, eval_items, minimum).groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.max("n_words").alias("longest"))


def without_leaks(documents: DataFrame, eval_items: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """The documents that contain no passage, with all their columns."""
    return documents.join(leaks(documents, eval_items, minimum).select("doc_id").distinct(), "doc_id", "left_anti")
