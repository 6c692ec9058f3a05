"""Products of sparse tables in blocks: entries of equal key meet, and the pairs of their records are kept that a bound allows.

A sparse table is shipped in chunks: one row holds the entries of one bucket (a range of hashed keys, that is
a block of columns) that came out of one Arrow batch, packed as arrays, with a small table of the records they
belong to. A task takes one bucket, sorts its entries by key and multiplies them in NumPy, in steps of at most
``STEP`` pairs. The number of buckets follows the number of entries, so a bucket's size does not grow with the
data. A bucket that is too large all the same, because of a hot key, is cut into parts, and each pair of parts
becomes a task of its own: nothing is gathered beyond ``PART`` entries, and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.store import cut

STEP = 1_000_000
PART = 3_000_000
CHUNK = "bucket int, entries int, key binary, rec binary, most binary, rid binary, size binary, plane binary"
FIELDS = [c.split()[0] for c in CHUNK.split(", ")]
_TYPES = {"bucket": pa.int32(), "entries": pa.int32()}
PAIRS = "a long, b long, shared int, old boolean"
#: Records of one chunk at most, so that a record's number fits 16 bits.
RECORDS = 50_000


class Records:
    """The records of some entries: 64-bit names, sizes and bit planes."""

    def __init__(self, rid: np.ndarray, size: np.ndarray, plane: np.ndarray):
        self.rid, self.size, self.plane = rid, size, plane


class Entries:
    """Entries sorted by key: ``key``, the record's number ``rec``, and ``most``, the overlap that is still possible from here on."""

    def __init__(self, key: np.ndarray, rec: np.ndarray, most: np.ndarray, records: Records):
        self.key, self.rec, self.most, self.records = key, rec, most, records

    def __len__(self) -> int:
        return len(self.key)

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        at = np.cumsum([0, *[len(p.records.rid) for p in parts]])
        rid, size, plane = (np.concatenate([getattr(p.records, f) for p in parts]) for f in ("rid", "size", "plane"))
        return Entries(
            np.concatenate([p.key for p in parts]), np.concatenate([p.rec.astype(np.int64) + a for p, a in zip(parts, at, strict=False)]),
            np.concatenate([p.most for p in parts]), Records(rid, size, plane),
        )

    def ordered(self, first: np.ndarray | None = None) -> Entries:
        """By key; of equal keys those marked ``first`` lead."""
        o = np.argsort(self.key, kind="stable") if first is None else np.lexsort((~first, self.key))
        return Entries(self.key[o], self.rec[o], self.most[o], self.records)


def packed(bucket: np.ndarray, key: np.ndarray, rec: np.ndarray, most: np.ndarray, records: Records) -> Iterator[dict]:
    """Chunk rows of entries, one per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, key, rec, most = bucket[order], key[order], rec[order], most[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
        used, mine = np.unique(rec[a:b], return_inverse=True)
        yield {
            "bucket": int(bucket[a]), "entries": int(b - a), "key": key[a:b].astype(np.uint32).tobytes(), "rec": mine.astype(np.uint16).tobytes(),
            "most": most[a:b].astype(np.uint32).tobytes() if most[a:b].any() else b"", "rid": records.rid[used].tobytes(),
            "size": records.size[used].astype(np.uint32).tobytes(), "plane": records.plane[used].tobytes(),
        }


def unpacked(row: dict) -> Entries:
    rid = np.frombuffer(row["rid"], np.int64)
    plane = np.frombuffer(row["plane"], np.uint64).reshape(len(rid), -1)
    key = np.frombuffer(row["key"], np.uint32)
    most = np.frombuffer(row["most"], np.uint32) if row["most"] else np.zeros(len(key), np.uint32)
    return Entries(key, np.frombuffer(row["rec"], np.uint16), most, Records(rid, np.frombuffer(row["size"], np.uint32), plane))


def emitted(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _TYPES.get(n, pa.binary())) for n in names], names=names)


def chunks(df: DataFrame, entries: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """Chunk rows of a table (rid LONG, hs ARRAY<LONG>) by ``entries(rid, values, bounds)`` -> (bucket, key, rec, most, Records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, RECORDS):
                part = b.slice(at, RECORDS)
                hs = part.column("hs")
                bounds = np.asarray(hs.offsets, dtype=np.int64)
                values = hs.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] if len(hs) else np.zeros(0, np.int64)
                rows = list(packed(*entries(part.column("rid").to_numpy(), values, bounds - bounds[0])))
                if rows:
                    yield emitted(rows, FIELDS)

    return df.select("rid", "hs").mapInArrow(run, CHUNK)


def _spread(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive stretches of rows whose counts sum to at most ``STEP`` (a single larger one stands alone)."""
    total = np.concatenate([[0], np.cumsum(counts)])
    a = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + STEP, "right")) - 1)
        yield a, b
        a = b


def _runs(start: np.ndarray, count: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left, right) numbers: each ``own`` entry with ``count`` entries from ``start`` on."""
    keep = count > 0
    start, count, own = start[keep], count[keep], own[keep]
    for a, b in _spread(count):
        if b == a + 1 and count[a] > STEP:
            for k in range(0, int(count[a]), STEP):
                right = np.arange(start[a] + k, start[a] + min(k + STEP, int(count[a])))
                yield np.full(len(right), own[a]), right
            continue
        c = count[a:b]
        first = np.repeat(np.cumsum(c) - c, c)
        yield np.repeat(own[a:b], c), np.arange(c.sum()) - first + np.repeat(start[a:b], c)


class Sums:
    """Pairs of records with the number of entries they share, accumulated."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([a, b], axis=1))
            self.held += len(a)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.concatenate(self.parts) if self.parts else np.zeros((0, 2), np.int64)
        self.parts, self.held = [], 0
        order = np.lexsort((both[:, 1], both[:, 0]))
        both = both[order]
        new = np.flatnonzero(np.r_[True, (both[1:] != both[:-1]).any(axis=1)]) if len(both) else np.zeros(0, np.int64)
        return both[new, 0], both[new, 1], np.diff(np.r_[new, len(both)])


def product(left: DataFrame, right: DataFrame | None, fits: Callable, leads: Callable | None = None, part: int = PART) -> DataFrame:
    """(a, b, shared, old): pairs of records that share an entry, where ``fits`` allows them; a pair may come from several tasks.

    Pairs of ``left`` with itself (a < b) and, if ``right`` is given, of ``left`` (a) with ``right`` (b), marked ``old``.
    ``fits(la, lb, ra, rb)`` is given entry numbers and ``Entries`` of both sides and returns a mask. ``leads``
    marks the entries one of which every pair of ``left`` with itself must hold.
    """
    names = ["bucket", "part", "with", "side", *FIELDS[1:]]
    left = cut(left, "entries")
    # Buckets beyond the bound are cut into parts; each pair of parts is a task. Their number is that of hot buckets.
    split = left.groupBy("bucket").agg(F.ceil(F.sum("entries") / part).cast("int").alias("parts"))
    l = left.join(split, "bucket").withColumn("mine", F.pmod(F.xxhash64("rid", "key"), F.col("parts")).cast("int"))
    body = FIELDS[1:]
    tasks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least("mine", k).alias("part"), F.greatest("mine", k).alias("with"), F.when(F.col("mine") <= k, 0).otherwise(1).alias("side")))
    all_ = l.select("bucket", F.inline(tasks), *body)
    if right is not None:
        every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(k.alias("part"), k.alias("with"), F.lit(2).alias("side")))
        all_ = all_.unionByName(right.join(split, "bucket").select("bucket", F.inline(every), *body))
    rows = all_.select(*names).repartition("bucket", "part", "with").sortWithinPartitions("bucket", "part", "with", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, mine, sums = None, [], None, Sums()

        def flush(old: bool) -> Iterator[pa.RecordBatch]:
            if sums.held:
                a, b, n = sums.take()
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(np.full(len(a), old))], names=["a", "b", "shared", "old"])

        def own() -> Iterator[pa.RecordBatch]:
            """Sorts what is held of the left side, and multiplies it with itself in a task of one part."""
            nonlocal mine
            e = Entries.joined(held)
            mine = e.ordered(leads(e) if leads else None)
            if at[1] != at[2]:
                return
            ends = np.searchsorted(mine.key, mine.key, "right")
            first = np.flatnonzero(leads(mine)) if leads else np.arange(len(mine))
            for x, y in _runs(first + 1, ends[first] - first - 1, first):
                ok = fits(mine, mine, x, y)
                a, b = mine.records.rid[mine.rec[x[ok]]], mine.records.rid[mine.rec[y[ok]]]
                apart = a != b
                sums.add(np.minimum(a, b)[apart], np.maximum(a, b)[apart])
                if sums.held > 2 * STEP:
                    yield from flush(False)
            yield from flush(False)

        def across(e: Entries, old: bool) -> Iterator[pa.RecordBatch]:
            lo, hi = np.searchsorted(mine.key, e.key, "left"), np.searchsorted(mine.key, e.key, "right")
            for y, x in _runs(lo, hi - lo, np.arange(len(e))):
                ok = fits(mine, e, x, y)
                a, b = mine.records.rid[mine.rec[x[ok]]], e.records.rid[e.rec[y[ok]]]
                if not old:
                    apart = a != b
                    a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
                sums.add(a, b)
                if sums.held > 2 * STEP:
                    yield from flush(old)

        side = 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                key = (row["bucket"], row["part"], row["with"])
                if key != at:
                    if held and mine is None:
                        yield from own()
                    yield from flush(side == 2)
                    at, held, mine = key, [], None
                elif row["side"] != side:
                    yield from flush(side == 2)
                side = row["side"]
                if side == 0:
                    held.append(unpacked(row))
                elif held:
                    if mine is None:
                        yield from own()
                    yield from across(unpacked(row), side == 2)
        if held and mine is None:
            yield from own()
        yield from flush(side == 2)

    return rows.mapInArrow(run, PAIRS)
