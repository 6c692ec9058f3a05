"""Word sets: tokens, hashes, a bounded table of word frequencies, and similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-9
#: Cells of the table of word frequencies. Its size is fixed (4 bytes a cell), whatever the vocabulary.
CELLS = 1 << 20


def words(*texts: Column) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased texts; nulls count as empty."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *texts)), "[^a-z0-9]+"), lambda w: w != ""))


def hashes(words_: str | Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def set_key(words_: str) -> Column:
    """128 bits that stand for a sorted set of words, so that equal sets meet without their texts being shuffled."""
    return F.unhex(F.md5(F.concat_ws(" ", words_)))


def frequencies(sets: DataFrame, column: str = "hs") -> np.ndarray:
    """Sets that hold a word of each cell, over all rows: an array of ``CELLS`` counts, at least the frequency of every word in the cell.

    At most ``CELLS`` sums reach the driver, whatever the data. Any array gives a valid order of the words;
    a crowded cell only makes its words count as more frequent than they are.
    """
    cells = sets.select(F.explode(column).alias("h")).groupBy(F.pmod("h", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").alias("n"))
    out = np.zeros(CELLS, np.uint32)
    got = cells.toPandas()
    out[got["cell"].to_numpy(np.int64)] = np.minimum(got["n"].to_numpy(np.int64), 2**32 - 1)
    return out


def jaccard(x: Column, y: Column) -> Column:
    """|x and y| / |x or y| of two arrays without repeats; 0 if both are empty."""
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))
