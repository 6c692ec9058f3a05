"""Pairs of records whose weighted field overlaps may reach a threshold, out of tables too large to compare pairwise.

Records are packed into chunks, one or more of each partition: a chunk holds its words once, as 64-bit names, and of
each record the codes of its words. Chunks are dealt to blocks, whose number follows the number of records and not
the files or partitions they came in. A task gets two blocks (or one with itself), joins them on indexed words,
discards what bounds from bitmaps rule out, counts the common words of the rest field by field and returns only pairs
that reach the threshold. So neither the pairs that meet nor their word sets are ever written; what is shuffled is
each chunk once for every block of the other side.

The join is exact. All words have one global order, the frequent and light ones first. A record leaves out of the
index the longest run of its first words that alone could not reach the threshold with any partner; the last
common word of a similar pair is in neither run, so the pair meets in the index. Any count of the frequencies gives
a valid order, so they are counted in ``CELLS`` cells. Names are checked to differ for different words and fields.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.store import cut

#: Cells of the table of word frequencies. Its size is fixed, whatever the vocabulary.
CELLS = 1 << 20
#: Records of a chunk at most, and of a block about; blocks smaller than ``LEAST`` are made only to have ``TASKS`` pairs of blocks.
CHUNK, BLOCK, LEAST, TASKS = 10_000, 50_000, 2_000, 24
#: Meetings of one step, and of the records whose pairs are collected at a time (a record with more stands alone).
STEP, ROUND = 1 << 18, 1 << 20
#: Marks of words held at a time when common words are counted.
MARKS = 1 << 23
SLACK = 1e-6
_PACKED = "chunk long, records int, ids array<string>, groups array<string>, names binary, kinds binary, codes binary, sizes binary, first binary"
_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
#: Fields, and 64-bit words of the bitmap of each.
WIDTH, _PLANES = 4, (1, 1, 4, 4)


class Weights:
    """Fields in order: (weight, whether the overlap is taken of the larger set instead of the mean, what a shared word of a usual record adds)."""

    def __init__(self, fields: dict[str, tuple[float, bool, float]]):
        self.names = list(fields)
        self.weight, self.larger, self.usual = (np.array(c) for c in zip(*fields.values(), strict=True))

    def reach(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The most that ``counts`` common words of each field add up to with any partner."""
        total = np.zeros(len(counts))
        for k, w in enumerate(self.weight):
            c, n = counts[:, k], sizes[:, k]
            total += w * (c / np.maximum(n, 1) if self.larger[k] else 2.0 * c / np.maximum(n + c, 1))
        return total

    def score(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        total = np.zeros(len(common))
        for k, w in enumerate(self.weight):
            a, b = n[:, k], m[:, k]
            total += w * (common[:, k] / np.maximum(np.maximum(a, b), 1) if self.larger[k] else 2.0 * common[:, k] / np.maximum(a + b, 1))
        return total


def named(sets: list[DataFrame], fields: list[str], group: str | None) -> list[DataFrame]:
    """(id, grp, arrays of 64-bit names of the words of each field) of the tables, with the first seed under which no two words of any fields share a name."""
    def each(field: int, made: Callable[[Column, Column], Column]) -> Column:
        return F.transform(fields[field], lambda w: made(F.lit(field), w))

    words = None
    for t in sets:
        w = t.select(F.inline(F.flatten(F.array(*[each(k, lambda field, w: F.struct(field.alias("field"), w.alias("w"))) for k in range(len(fields))]))))
        words = w if words is None else words.unionByName(w)
    one, seed = F.struct("field", "w"), 0
    while words.groupBy(F.xxhash64(F.lit(seed), "field", "w").alias("h")).agg((F.min(one) != F.max(one)).alias("two")).where("two").limit(1).count():
        seed += 1
    grp = F.col(group) if group else F.lit("")
    names = [each(k, lambda field, w: F.xxhash64(F.lit(seed), field, w)).alias(f) for k, f in enumerate(fields)]
    return [t.select("id", grp.alias("grp"), *names).where("id is not null and grp is not null") for t in sets]


def frequencies(tables: list[DataFrame], fields: list[str]) -> np.ndarray:
    """Records that hold a word of each cell, over all tables and fields; at most ``CELLS`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for b in batches:
            for f in fields:
                n += np.bincount(cell(_values(b.column(f))), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["cell", "n"])

    out = np.zeros(CELLS, np.float64)
    for t in tables:
        got = t.select(*fields).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        out[got["cell"].to_numpy()] += got["n"].to_numpy()
    return out


def cell(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) & np.uint64(CELLS - 1)).astype(np.int64)


def _values(column: pa.Array) -> np.ndarray:
    at = np.asarray(column.offsets)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]] if len(column) else np.zeros(0, np.int64)


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def _stretches(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] numbers), then those from start[1] on, and so on."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def packed(columns: list[np.ndarray], sizes: np.ndarray, table: np.ndarray, weights: Weights, threshold: float) -> tuple[np.ndarray, ...]:
    """(names, field of each, the names' numbers of all records' words in the global order, place of each record's first indexed word); ``columns``: names by field."""
    n, width = len(sizes), len(columns)
    name = np.concatenate(columns).astype(np.uint64)
    field = np.repeat(np.arange(width), [len(c) for c in columns])
    rec = np.concatenate([np.repeat(np.arange(n), sizes[:, k]) for k in range(width)])
    rate = table[cell(name)] / weights.usual[field]
    names, some, codes = np.unique(name, return_index=True, return_inverse=True)
    kinds = field[some]
    order = np.lexsort((codes, field, -rate, rec))
    rec, field, codes = rec[order], field[order], codes[order]
    bounds = _starts(sizes.sum(axis=1))
    counts = np.stack([np.cumsum(field == k) for k in range(width)], axis=1)
    before = np.concatenate([np.zeros((1, width), np.int64), counts])[bounds[:-1]]
    reach = weights.reach(counts - before[rec], sizes[rec])
    below = np.bincount(rec[reach < threshold - SLACK], minlength=n)
    return names, kinds.astype(np.uint8), codes.astype(np.uint16 if len(names) <= 1 << 16 else np.uint32), below.astype(np.uint32)


def chunks(sets: DataFrame, weights: Weights, table: np.ndarray, threshold: float) -> DataFrame:
    """Packed rows, of at most ``CHUNK`` records of one partition each."""
    fields = weights.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.RecordBatch] = []
        made = 0

        def row() -> pa.RecordBatch:
            nonlocal made
            whole = pa.Table.from_batches(held).combine_chunks()
            column = {f: whole.column(f).combine_chunks() for f in fields}
            sizes = np.stack([np.diff(np.asarray(column[f].offsets)) for f in fields], axis=1).astype(np.int64)
            names, kinds_, codes, first = packed([_values(column[f]) for f in fields], sizes, table, weights, threshold)
            chunk = (TaskContext.get().partitionId() << 32) + made
            made += 1
            values = [chunk, whole.num_rows, whole.column("id").to_pylist(), whole.column("grp").to_pylist(), names.tobytes(), kinds_.tobytes(), codes.tobytes(), sizes.astype(np.uint32).tobytes(), first.tobytes()]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=_NAMES)

        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                held.append(b.slice(at, CHUNK - n))
                n += held[-1].num_rows
                at += held[-1].num_rows
                if n == CHUNK:
                    yield row()
                    held, n = [], 0
        if n:
            yield row()

    return sets.mapInArrow(run, _PACKED)


def dealt(records: list[tuple[int, int]], blocks: int) -> dict[int, int]:
    """The block of each of the (chunk, records): the largest first, each to the block that has the fewest records so far."""
    held = [(0, b) for b in range(blocks)]
    out = {}
    for n, chunk in sorted(((n, c) for c, n in records), reverse=True):
        so_far, b = heapq.heappop(held)
        out[chunk] = b
        heapq.heappush(held, (so_far + n, b))
    return out


def numbers(left: int, right: int | None) -> tuple[int, int]:
    """Blocks of so many records of either side; the larger side gives the blocks that are made for the sake of tasks, as the smaller one is then shipped more often."""
    a, b = max(1, -(-left // BLOCK)), max(1, -(-(right or 0) // BLOCK))
    if right is None:
        while a * (a + 1) // 2 < TASKS and a * LEAST < left:
            a += 1
    elif left > right:
        a = max(a, min(-(-TASKS // b), left // LEAST))
    else:
        b = max(b, min(-(-TASKS // a), right // LEAST))
    return a, b


class Block:
    def __init__(self, *rows: dict):
        joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        self.ids, self.groups = (np.array([v for r in rows for v in r[name]], object) for name in ("ids", "groups"))
        own = [np.frombuffer(r["names"], np.uint64) for r in rows]
        self.names, at = np.unique(np.concatenate(own), return_inverse=True)
        kinds = np.zeros(len(self.names), np.int64)
        kinds[at] = joined("kinds", np.uint8)
        at = np.split(at, np.cumsum([len(n) for n in own])[:-1])
        self.sizes = joined("sizes", np.uint32).reshape(-1, WIDTH).astype(np.int64)
        self.codes = np.concatenate([a[np.frombuffer(r["codes"], np.uint16 if len(a) <= 1 << 16 else np.uint32)] for r, a in zip(rows, at, strict=True)])
        self.fields = kinds[self.codes]
        self.bounds = _starts(self.sizes.sum(axis=1))
        self.first = self.bounds[:-1] + joined("first", np.uint32)
        rec = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))
        bit = self.names[self.codes] >> np.uint64(40)
        self.planes = []
        for k, width in enumerate(_PLANES):
            mine = self.fields == k
            plane = np.zeros((width, len(self.ids)), np.uint64)
            np.bitwise_or.at(plane, ((bit[mine] >> np.uint64(6)) % np.uint64(width), rec[mine]), np.uint64(1) << (bit[mine] & np.uint64(63)))
            self.planes.append(plane)
        self.size = np.ascontiguousarray(self.sizes.T, dtype=np.int32)

    def indexed(self, codes: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, record) of the indexed words, record by record; a key stands for a word of a group."""
        count = self.bounds[1:] - self.first
        rec = np.repeat(np.arange(len(self.ids)), count)
        return codes[_stretches(self.first, count)] * len(groups) + np.searchsorted(groups, self.groups)[rec], rec


def similar(left: Block, right: Block | None, weights: Weights, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(record of left, record of right, common words by field) of each pair of one group that may reach the threshold; without ``right`` of left with itself.

    The pairs of a record of ``right`` are collected, and so made distinct, together.
    """
    own = right is None
    right = left if own else right
    names, groups = np.union1d(left.names, right.names), np.union1d(left.groups, right.groups)
    lc, rc = (np.searchsorted(names, b.names)[b.codes] for b in (left, right))
    lk, lr = left.indexed(lc, groups)
    order = np.argsort(lk, kind="stable")
    rk, rr = (lk, lr) if own else right.indexed(rc, groups)
    lk, lr = lk[order], lr[order]
    lo = np.searchsorted(lk, rk, "left")
    if own:  # those of the key's records that come before
        hi = np.empty(len(order), np.int64)
        hi[order] = np.arange(len(order))
    else:
        hi = np.searchsorted(lk, rk, "right")
    n = hi - lo
    entry = _starts(np.bincount(rr, minlength=len(right.ids)))
    total = _starts(n)
    met = total[entry]
    a = 0
    while a < len(right.ids):
        b = max(a + 1, int(np.searchsorted(met, met[a] + ROUND, "right")) - 1)
        kept = [np.zeros(0, np.int64)]
        e = entry[a]
        while e < entry[b]:
            f = min(int(entry[b]), max(e + 1, int(np.searchsorted(total, total[e] + STEP, "right")) - 1))
            x, y = lr[_stretches(lo[e:f], n[e:f])], np.repeat(rr[e:f], n[e:f])
            ok = _possible(left, right, x, y, weights, threshold)
            kept.append(y[ok] * len(left.ids) + x[ok])
            e = f
        pairs = np.unique(np.concatenate(kept))
        if len(pairs):
            y, x = np.divmod(pairs, len(left.ids))
            for i, common in _counted(left, right, lc, rc, len(names), x, y):
                may = weights.score(common, left.sizes[x[i]], right.sizes[y[i]]) >= threshold - SLACK
                yield x[i][may], y[i][may], common[may]
        a = b


def _possible(left: Block, right: Block, x: np.ndarray, y: np.ndarray, weights: Weights, threshold: float) -> np.ndarray:
    """Numbers of the pairs that the bitmaps allow: bits that differ never outnumber the words that do."""
    at, bound = np.arange(len(x)), np.zeros(len(x), np.float32)
    for k, w in enumerate(weights.weight):
        n, m = left.size[k][x], right.size[k][y]
        twice = n + m
        whole = np.maximum(np.maximum(n, m) * 2 if weights.larger[k] else twice, 1)
        for p, q in zip(left.planes[k], right.planes[k], strict=True):
            twice = twice - np.bitwise_count(p[x] ^ q[y])
        bound += np.float32(w) * (twice / whole.astype(np.float32))
        least = threshold - 1e-4 - weights.weight[k + 1 :].sum()
        if least > 0:
            ok = np.flatnonzero(bound >= least)
            at, bound, x, y = at[ok], bound[ok], x[ok], y[ok]
    return at


def _counted(left: Block, right: Block, lc: np.ndarray, rc: np.ndarray, words: int, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of pairs, their common words by field); the pairs are ordered by ``y``."""
    step = max(1, MARKS // words)
    marks = np.zeros((step, words), bool)
    heads = np.append(np.flatnonzero(np.r_[True, y[1:] != y[:-1]]), len(y))
    for h in range(0, len(heads) - 1, step):
        at = heads[h : h + step + 1]
        mine = y[at[:-1]]
        count = right.bounds[mine + 1] - right.bounds[mine]
        where = np.repeat(np.arange(len(mine)), count), rc[_stretches(right.bounds[mine], count)]
        marks[where] = True
        slot = np.repeat(np.arange(len(mine)), np.diff(at))
        for s in range(at[0], at[-1], 1 << 15):
            i = np.arange(s, min(at[-1], s + (1 << 15)))
            count = left.bounds[x[i] + 1] - left.bounds[x[i]]
            t = _stretches(left.bounds[x[i]], count)
            hit = np.flatnonzero(marks[np.repeat(slot[i - at[0]], count), lc[t]])
            pair = np.repeat(np.arange(len(i)), count)[hit]
            yield i, np.bincount(pair * WIDTH + left.fields[t[hit]], minlength=WIDTH * len(i)).reshape(-1, WIDTH)
        marks[where] = False


def pairs(left: DataFrame, right: DataFrame | None, weights: Weights, threshold: float, group: str | None = None) -> DataFrame:
    """(grp, id_a, id_b, common, sizes_a, sizes_b): pairs of ``left`` and ``right`` that may reach the threshold, once each.

    Without ``right`` pairs of ``left`` with itself, smaller id first. Both hold ``id`` and an array of distinct words
    for each field. With ``group`` only pairs that are equal in that column. The arrays follow the order of the
    fields; what is left out lies below the threshold, so the exact score remains to be compared.
    """
    sides = named([left] if right is None else [left, right], weights.names, group)
    table = frequencies(sides, weights.names)
    packs = [cut(chunks(s, weights, table, threshold), "overlap-blocks") for s in sides]
    # One row for each chunk, that is for up to CHUNK records of a partition.
    records = [[tuple(r) for r in p.select("chunk", "records").collect()] for p in packs]
    many = numbers(*(sum(n for _, n in r) for r in records), *[None] * (right is None))

    def spread(k: int) -> DataFrame:
        """Chunks of a side, once for each task; ``task`` numbers the pairs of blocks."""
        block = dealt(records[k], many[k])
        p = packs[k].withColumn("block", F.lit(list(block.values()))[F.array_position(F.lit(list(block)), F.col("chunk")).cast("int") - 1]) if block else packs[k].withColumn("block", F.lit(0))
        i = F.col("block")
        if right is None:
            tasks = F.transform(F.lit(list(range(many[0]))), lambda o: F.struct((F.greatest(i, o) * (F.greatest(i, o) + 1) / 2 + F.least(i, o)).cast("int").alias("task"), F.when(i <= o, 0).otherwise(1).alias("side"), (i == o).alias("alone")))
        else:
            tasks = F.transform(F.lit(list(range(many[1 - k]))), lambda o: F.struct(((i * many[1] + o) if k == 0 else (o * many[1] + i)).cast("int").alias("task"), F.lit(k).alias("side"), F.lit(False).alias("alone")))
        return p.select(F.inline(tasks), *_NAMES)

    rows = spread(0)
    if right is not None:
        rows = rows.unionByName(spread(1))
    several = many[0] * (many[0] + 1) // 2 if right is None else many[0] * many[1]
    rows = rows.repartitionById(several, "task").sortWithinPartitions("task", "side")
    out = "grp string, id_a string, id_b string, common array<int>, sizes_a array<int>, sizes_b array<int>"
    alone = right is None

    def met(a: Block, b: Block | None) -> Iterator[pa.RecordBatch]:
        for x, y, common in similar(a, b, weights, threshold):
            other = a if b is None else b
            p, q, n, m = a.ids[x], other.ids[y], a.sizes[x], other.sizes[y]
            if alone:
                turn = np.array(p > q, bool)
                p, q, n, m = np.where(turn, q, p), np.where(turn, p, q), np.where(turn[:, None], m, n), np.where(turn[:, None], n, m)
            numbers_ = [pa.array(list(c.astype(np.int32)), pa.list_(pa.int32())) for c in (common, n, m)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (a.groups[x], p, q)] + numbers_, names=[c.split()[0] for c in out.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chunks of a task's first block come before those of its second."""
        at, only = None, False
        held: tuple[list, list] = [], []

        def whole() -> Iterator[pa.RecordBatch]:
            sides = [Block(*h) if h else None for h in held]
            for h in held:
                h.clear()
            if sides[0] and (only or sides[1]):
                yield from met(*sides)

        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if row["task"] != at:
                    yield from whole()
                at, only = row["task"], row["alone"]
                held[row["side"]].append(row)
        yield from whole()

    return rows.mapInArrow(run, out)
