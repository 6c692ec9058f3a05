"""New batches checked against everything accepted before.

Each accepted record has a bit-difference fingerprint of ``BITS`` components, taken from min-hashes of its
words: two records of similarity J agree in a component with probability J, and in its lowest bit with
(1 + J) / 2. The fingerprint is stored in ``TABLES`` rotations: table j leads with block j, ``LEAD`` components
of 8 bits. A new record is looked up by exact block matches in every table; the differing low bits of two
fingerprints are then held against the most that a repeat may show (its mean and five deviations), and what is
left is verified on the words. At J = 0.6 a repeat shares no block with probability (1 - 0.6^4)^64 = 1.4e-4, at
0.64 with 8e-6; beyond that practically never.

A history lies under a path and can be opened again by any application: block tables in directories by bucket
(a range of hashed block values), word sets in directories by record, members of classes, and a log of
generations. A batch is one generation: it reads the block tables of the buckets its blocks fall into and the
word sets of the records it may repeat, never the texts or fingerprints of the rest, and appends what it
accepts. A generation counts once its line is in the log, so a batch that fails half-way leaves nothing behind.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm import blocks as B
from lorewell.llm import wordsets as W
from lorewell.llm.near_dup import mixed
from lorewell.store import cut, folder, remove

THRESHOLD = 0.6
BITS, TABLES, LEAD = 256, 64, 4
#: Entries of a bucket that a new history aims at.
BUCKET = 1_000_000
SIGMAS = 5.0
MAX_GENERATIONS = 64
SETS = "rid long, class_id string, words array<string>, gen int, slot int"
MEMBERS = "rid long, class_id string, id string, gen int, slot int"
LOG = "gen int, first int, rows long, buckets int, threshold double"


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return rng.integers(0, 2**64, BITS, np.uint64) | np.uint64(1), rng.integers(0, 2**64, BITS, np.uint64)


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``BITS`` bytes for each non-empty stretch of word hashes."""
    h = mixed(values.astype(np.uint64), 3)
    times, plus = _functions()
    out = np.empty((len(bounds) - 1, BITS), np.uint8)
    for k in range(BITS):
        low = np.minimum.reduceat(h * times[k] + plus[k], bounds[:-1])
        out[:, k] = (mixed(low, k + 1) >> np.uint64(56)).astype(np.uint8)
    return out


def _rotated(buckets: int):
    def entries(rid: np.ndarray, values: np.ndarray, bounds: np.ndarray):
        n = len(rid)
        prints = fingerprints(values, bounds) if n else np.zeros((0, BITS), np.uint8)
        block = prints.reshape(n, TABLES, LEAD).copy().view(np.uint32).reshape(n, TABLES).astype(np.uint64)
        key = mixed(block, np.arange(1, TABLES + 1, dtype=np.uint64)[None, :]).ravel()
        plane = np.packbits(prints & 1, axis=1).view(np.uint64).reshape(n, BITS // 64)
        bucket = ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        rec = np.repeat(np.arange(n), TABLES)
        return bucket, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), rec, np.zeros(len(key), np.uint32), B.Records(rid, np.diff(bounds), plane)

    return entries


def _near(t: float):
    q = (1 - t) / 2
    most = BITS * q + SIGMAS * np.sqrt(BITS * q * (1 - q))

    def fits(l: B.Entries, r: B.Entries, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = l.rec[x], r.rec[y]
        n, m = l.records.size[a], r.records.size[b]
        ok = np.minimum(n, m) >= np.maximum(n, m) * t - W.EPS
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(l.records.plane[a[at]] ^ r.records.plane[b[at]]).sum(axis=1) <= most
        return ok

    return fits


class History:
    """Everything accepted so far, under ``path``.

    Accepted records with the same words form a class, named by its smallest id of the generation that brought
    it, and have one fingerprint, so a group of copies costs as much as one record. Records without a word repeat
    nothing. Nulls in texts or triggers count as empty; null ids are dropped; of repeated ids one counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        log = spark.read.schema(LOG).parquet(f"{path}/log").collect()
        if not log:
            raise ValueError(f"no history at {path}")
        last = max(log, key=lambda r: r.gen)
        self.gen, self.first, self.buckets, self.threshold = last.gen, last.first, last.buckets, last.threshold
        self.rows = sum(r.rows for r in log if r.gen >= last.first)

    @staticmethod
    def open(spark: SparkSession, path: str) -> History:
        return History(spark, path)

    @staticmethod
    def create(spark: SparkSession, path: str, accepted: DataFrame, threshold: float = THRESHOLD, buckets: int | None = None) -> History:
        """A new history of (id, words), all accepted as they are. The number of buckets follows their number unless it is given."""
        words = accepted.select("id", F.array_sort("words").alias("words")).where("id is not null and size(words) > 0").dropDuplicates(["id"])
        rows = cut(words.select("*", W.set_key("words").alias("key")), "history-rows")
        classes = cut(rows.groupBy("key").agg(F.min("id").alias("class_id"), F.first("words").alias("words")), "history-sets")
        sets, members = classes.select("class_id", "words"), rows.select("id", "key").join(classes.select("key", "class_id"), "key").select("class_id", "id")
        n = sets.count()
        History._write(spark, path, 0, 0, sets, members, n, buckets or max(8, -(-n * TABLES // BUCKET)), threshold)
        return History(spark, path)

    @staticmethod
    def _write(spark: SparkSession, path: str, gen: int, first: int, sets: DataFrame, members: DataFrame, rows: int, buckets: int, threshold: float) -> None:
        slotted = lambda df: df.select(F.xxhash64("class_id").alias("rid"), "*").withColumn("slot", F.pmod("rid", F.lit(buckets)).cast("int"))
        entries = B.chunks(sets.select(F.xxhash64("class_id").alias("rid"), W.hashes("words").alias("hs")), _rotated(buckets))
        for name, df, by in (("blocks", entries, "bucket"), ("sets", slotted(sets), "slot"), ("members", slotted(members), "slot")):
            df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}/gen={gen}")
        spark.createDataFrame([(gen, first, rows, buckets, threshold)], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")

    def _table(self, name: str, schema: str, by: str, hit: DataFrame) -> DataFrame:
        """The rows of a table in the directories that ``hit`` (one integer column) names, at most as many as there are buckets."""
        at = [r[0] for r in hit.distinct().collect()]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("gen").between(self.first, self.gen) & F.col(by).isin(at))

    def sets(self) -> DataFrame:
        """(id, words): the accepted classes."""
        return self.spark.read.schema(SETS).parquet(f"{self.path}/sets").where(F.col("gen").between(self.first, self.gen)).select(F.col("class_id").alias("id"), "words")

    def _met(self, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Verified repeats (new_id, old_id, similarity) of batch classes (id, words): with the history, and (in no order) among themselves."""
        t = self.threshold
        named = sets.select(F.xxhash64("id").alias("rid"), "id", "words")
        entries = cut(B.chunks(named.select("rid", W.hashes("words").alias("hs")), _rotated(self.buckets)), "batch-blocks")
        old = self._table("blocks", f"{B.CHUNK}, gen int", "bucket", entries.select("bucket"))
        pairs = cut(B.product(entries, old.select(*B.FIELDS), _near(t)).select("a", "b", "old").distinct(), "batch-pairs")
        slots = pairs.where("old").select(F.pmod("b", F.lit(self.buckets)).cast("int").alias("slot"))
        known = self._table("sets", SETS, "slot", slots).select(F.col("rid").alias("b"), F.col("class_id").alias("old_id"), F.col("words").alias("wo"))
        a = named.select(F.col("rid").alias("a"), F.col("id").alias("new_id"), F.col("words").alias("wn"))
        b = named.select(F.col("rid").alias("b"), F.col("id").alias("old_id"), F.col("words").alias("wo"))

        def checked(met: DataFrame) -> DataFrame:
            return met.withColumn("similarity", W.jaccard(F.col("wn"), F.col("wo"))).where(F.col("similarity") >= t - W.EPS).select("new_id", "old_id", "similarity")

        before = checked(pairs.where("old").join(a, "a").join(known, "b"))
        return cut(before, "batch-old"), cut(checked(pairs.where("not old").join(a, "a").join(b, "b").where("new_id <> old_id")), "batch-inner")

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes a batch (id, words, and an orderable ``turn``), appends what it accepts, and returns the repeats.

        The result is (new_id, old_id, similarity): each record of the batch that repeats an accepted one, with
        every accepted record it repeats. Within a batch records are taken by ``turn``, then id: a record is
        accepted if it repeats nothing accepted before it. Several batches may come as one, with the batch
        number leading in ``turn``; the result is the same. An empty batch adds an empty generation.

        Of records of the batch with the same words only the first can be accepted, so it stands for them.
        """
        one = batch.where("id is not null").groupBy("id").agg(F.min_by("words", "turn").alias("words"), F.min("turn").alias("turn"))
        words = one.select("id", F.array_sort("words").alias("words"), F.struct("turn", "id").alias("at")).where("size(words) > 0")
        rows = cut(words.select("*", W.set_key("words").alias("key")), "batch")
        lead = rows.groupBy("key").agg(F.min("at").alias("lead_at"), F.first("words").alias("words"))
        sets = cut(lead.select(F.col("lead_at.id").alias("id"), "words", "lead_at", "key"), "batch-sets")
        mine = cut(rows.select("id", "at", "key").join(sets.select(F.col("id").alias("lead"), "key"), "key").select("id", "lead", "at"), "batch-members")
        old, links = self._met(sets.select("id", "words"))
        at = sets.select("id", "lead_at")
        placed = links.join(at.select(F.col("id").alias("new_id"), F.col("lead_at").alias("new_at")), "new_id").join(at.select(F.col("id").alias("old_id"), F.col("lead_at").alias("old_at")), "old_id")
        later = lambda a, b: F.when(F.col("old_at") < F.col("new_at"), F.col(a)).otherwise(F.col(b))
        inner = placed.select(later("new_id", "old_id").alias("new_id"), later("old_id", "new_id").alias("old_id"))

        # A record is out once it repeats an accepted one; it is in once everything before it that it resembles is out.
        # One round settles a level of the chains of resemblance; each round's table is written, and a round with nothing left ends it.
        # Every round settles at least the first open record of each chain, so the rounds end.
        out = cut(old.select(F.col("new_id").alias("id")).distinct(), "batch-out")
        open_links = cut(inner.join(out.select(F.col("id").alias("new_id")), "new_id", "left_anti").join(out.select(F.col("id").alias("old_id")), "old_id", "left_anti"), "batch-links")
        while not open_links.isEmpty():
            waiting = open_links.select(F.col("new_id").alias("id")).distinct()
            settled = open_links.select(F.col("old_id").alias("id")).distinct().join(waiting, "id", "left_anti")
            fallen = cut(open_links.join(settled.select(F.col("id").alias("old_id")), "old_id", "left_semi").select(F.col("new_id").alias("id")).distinct(), "batch-fallen")
            out = cut(out.unionByName(fallen), "batch-out")
            open_links = cut(open_links.join(fallen.select(F.col("id").alias("new_id")), "new_id", "left_anti").join(fallen.select(F.col("id").alias("old_id")), "old_id", "left_anti"), "batch-links")

        accepted = cut(sets.join(out, "id", "left_anti"), "batch-accepted")
        slots = old.select(F.pmod(F.xxhash64("old_id"), F.lit(self.buckets)).cast("int").alias("slot"))
        known = self._table("members", MEMBERS, "slot", slots).select(F.col("class_id").alias("old_id"), F.col("id").alias("member"))
        before = old.withColumnRenamed("new_id", "lead").join(known, "old_id").select("lead", F.col("member").alias("old_id"), "similarity")
        repeats = mine.join(before, "lead").select(F.col("id").alias("new_id"), "old_id", "similarity")
        both = links.unionByName(links.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("old_id"), "similarity")).unionByName(accepted.select(F.col("id").alias("new_id"), F.col("id").alias("old_id"), F.lit(1.0).alias("similarity")))
        near = both.join(accepted.select(F.col("id").alias("old_id"), F.col("lead_at").alias("old_at")), "old_id").withColumnRenamed("new_id", "lead")
        repeats = cut(repeats.unionByName(mine.join(near, "lead").where("old_at < at").select(F.col("id").alias("new_id"), "old_id", "similarity")), "batch-repeats")
        new = accepted.select(F.col("id").alias("class_id"), "words")
        count = new.count()
        self._write(self.spark, self.path, self.gen + 1, self.first, new, new.select("class_id", F.col("class_id").alias("id")), count, self.buckets, self.threshold)
        self.gen, self.rows = self.gen + 1, self.rows + count
        if self.gen - self.first >= MAX_GENERATIONS:
            self.compact()
        return repeats

    def compact(self) -> None:
        """Writes all generations as one, with as many buckets as their number asks for, and removes the old ones."""
        span = F.col("gen").between(self.first, self.gen)
        sets = self.spark.read.schema(SETS).parquet(f"{self.path}/sets").where(span).select("class_id", "words")
        members = self.spark.read.schema(MEMBERS).parquet(f"{self.path}/members").where(span).select("class_id", "id")
        old, new = range(self.first, self.gen + 1), self.gen + 1
        buckets = max(8, -(-self.rows * TABLES // BUCKET))
        self._write(self.spark, self.path, new, new, sets, members, self.rows, buckets, self.threshold)
        self.gen, self.first, self.buckets = new, new, buckets
        for g in old:
            for name in ("blocks", "sets", "members"):
                remove(self.spark, f"{self.path}/{name}/gen={g}")


def new_history(spark: SparkSession, accepted: DataFrame, threshold: float = THRESHOLD) -> History:
    """A history under a path of the shared folder that goes with the application's other tables."""
    return History.create(spark, folder(spark, "history"), accepted, threshold)


def record_words(columns: list[str], triggers: str | None = "triggers") -> Column:
    texts = [F.col(c) for c in columns]
    return W.words(*texts, F.concat_ws(" ", F.col(triggers)) if triggers else F.lit(""))
