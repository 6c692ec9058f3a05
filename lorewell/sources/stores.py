"""Document stores: partitioned JSON documents, Markdown documents and append-only JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lorewell.operators import rendering
from lorewell.operators.records import matching
from lorewell.operators.upserts import upsert
from lorewell.store import remove


class KeyedStore:
    """Records by id in Parquet under a path: episodes, patterns, skills, or any other.

    A change writes the next version of the table and then its marker; readers take the last marked version, so a
    failed change leaves the one before. The version before that is removed.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def _versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS"))
        return sorted(int(f.getPath().getParent().getName()[2:]) for f in (found or []))

    def table(self) -> DataFrame | None:
        """All records; None before the first were saved."""
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def save(self, rows: DataFrame) -> None:
        """Adds records, and replaces those of the same id; of repeated ids in ``rows`` one counts."""
        rows, old, versions = rows.dropDuplicates([self.key]), self.table(), self._versions()
        (rows if old is None else upsert(old, rows, self.key)).write.parquet(f"{self.path}/v={versions[-1] + 1 if versions else 0}")
        for v in versions[:-1]:
            remove(self.spark, f"{self.path}/v={v}")

    def update(self, ids: list[str], **values) -> None:
        """Sets columns of existing records; an id that does not exist is an error."""
        hit = self.table().where(F.col(self.key).isin(ids)) if self._versions() else None
        if hit is None or hit.count() < len(set(ids)):
            raise KeyError(f"not all of {ids} exist")
        self.save(hit.withColumns({k: F.lit(v).cast(dict(hit.dtypes)[k]) for k, v in values.items()}))

    def delete(self, ids: list[str]) -> None:
        """Removes records, such as the marks of sessions that are to be read again; unknown ids do not matter."""
        versions = self._versions()
        if versions:
            self.table().where(~F.col(self.key).isin(ids)).write.parquet(f"{self.path}/v={versions[-1] + 1}")

    def get(self, record: str) -> DataFrame:
        """The record of an id, or no row."""
        return self.table().where(F.col(self.key) == record)

    def list(self, **wanted) -> DataFrame:
        """The records equal in every given field."""
        return matching(self.table(), **wanted)


def save_episodes(eps: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON documents in one folder per year of the start."""
    eps.withColumn("year", F.coalesce(F.substring("started_at", 1, 4), F.lit("none"))).write.mode(mode).partitionBy("year").json(path)


def list_episodes(spark: SparkSession, path: str, schema: StructType, after: str | None = None, strict: bool = True) -> DataFrame:
    """The stored episodes. ``after`` is exclusive, by text, and also prunes years. ``strict`` fails on a broken document; else it is skipped."""
    full = StructType(schema.fields).add("year", "string")
    df = spark.read.schema(full).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    if after:
        df = df.where((F.col("year") >= after[:4]) & (F.col("started_at") > after))
    return df


def save_experiences(experiences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Markdown text per row in Parquet, a folder per scope."""
    rendering.experience_markdown(experiences).join(experiences.select("id", "scope"), "id").write.mode(mode).partitionBy("scope").parquet(path)


def list_experiences(spark: SparkSession, path: str, scope: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return rendering.experience_from_markdown(df.where(F.col("scope") == scope) if scope else df)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of a log; a log that does not exist is empty, broken lines are skipped."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
