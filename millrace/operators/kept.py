"""Sums per key that are kept in a folder and brought up to date by signed changes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "n_rows"


def signed_sums(
    rows: DataFrame, keys: list[str], sums: dict[str, Column], sign: str | None = None
) -> DataFrame:
    """Sums and ``n_rows`` per group, where a row counts as often as column ``sign`` says (1 and -1).

    Null values add nothing, and a null sign is refused. Map tasks sum first, so a hot key is harmless.
    """
    if sign is None:
        weight = F.lit(1)
    else:
        weight = F.coalesce(F.col(sign), F.raise_error(F.lit("a row without a sign")).cast("int"))
    added = [
        F.coalesce(F.sum(value * weight), F.lit(0)).alias(name) for name, value in sums.items()
    ]
    return rows.groupBy(*keys).agg(*added, F.sum(weight).cast("bigint").alias(ROWS))


class KeptSums:
    """The sums of all changes applied so far, in versions below ``folder``.

    A change has a name and is applied once, however often a restarted job asks for it. A version is
    complete with its list of applied names, which is written last; an incomplete one that a lost
    driver left is written over. Readers see complete versions only. One writer at a time. Sums have
    to be whole numbers or decimals, so that the order of changes does not matter.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], sums: list[str]) -> None:
        self.spark, self.folder, self.keys, self.sums = spark, folder.rstrip("/"), keys, sums

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        numbers = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path)]
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in numbers if files.exists(done(f"{self._at(n)}/applied/_SUCCESS")))

    def _at(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def applied(self) -> set[str]:
        versions = self._versions()
        if not versions:
            return set()
        rows = self.spark.read.schema("name string").parquet(f"{self._at(versions[-1])}/applied")
        return {r.name for r in rows.collect()}

    def current(self) -> DataFrame:
        """The sums as of the last complete version; an error before the first change."""
        versions = self._versions()
        if not versions:
            raise LookupError(f"no change was applied to {self.folder}")
        return self.spark.read.parquet(f"{self._at(versions[-1])}/sums")

    def apply(self, name: str, change: DataFrame) -> bool:
        """Add a result of :func:`signed_sums`; False if a change of this name was applied before.

        Groups left without rows go. Raises if more rows of a group are taken back than it has, or if
        sums remain where no row does, as the change then belongs to other rows.
        """
        names, versions = self.applied(), self._versions()
        if name in names:
            return False
        columns = [*self.keys, *self.sums, ROWS]
        both = change.select(*columns)
        if versions:
            both = self.current().select(*columns).unionByName(both)
        merged = both.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in columns[len(self.keys) :]))
        wrong = F.raise_error(F.lit(f"{name} takes back rows that are not there")).cast("bigint")
        remains = reduce(or_, (F.col(c) != 0 for c in self.sums), F.lit(False))
        checked = F.when((F.col(ROWS) < 0) | ((F.col(ROWS) == 0) & remains), wrong)
        merged = merged.withColumn(ROWS, checked.otherwise(F.col(ROWS)))
        kinds = change.schema
        merged = merged.filter(F.col(ROWS) != 0).select(
            *(F.col(c).cast(kinds[c].dataType).alias(c) for c in columns)
        )
        at = self._at(versions[-1] + 1 if versions else 1)
        merged.write.mode("overwrite").parquet(f"{at}/sums")
        done = self.spark.createDataFrame([(n,) for n in sorted(names | {name})], "name string")
        done.coalesce(1).write.mode("overwrite").parquet(f"{at}/applied")
        return True
