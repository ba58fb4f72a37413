"""Tables stored in an order, with a row for each file: pages by the last key, and places of rows, without sorting again.

A page is found by its files: the small table of files says where each begins and ends, so page n reads the files it lies in
and no others, however far into the table it is. Keys are compared in ascending order, nulls first; they name a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a file, at most.
FILE_ROWS = 100_000
FILES = "file string, first_at long, rows long, before long"


@dataclass
class Ordered:
    """rows: the table with `at`, which ascends by keys; files: for each file its name, number of rows, those in files before
    it (`before`), first `at`, and its least and greatest keys (structs low and high)."""

    rows: DataFrame
    files: DataFrame
    keys: list[str]

    def _beyond(self, after: tuple, end: str | None = None) -> Column:
        """Whether the keys (or those of a file's end) come after the given ones."""
        of = (lambda c: F.col(f"{end}.{c}")) if end else F.col
        out, same = F.lit(False), F.lit(True)
        for c, v in zip(self.keys, after, strict=True):
            more = of(c).isNotNull() if v is None else F.coalesce(of(c) > F.lit(v), F.lit(False))
            out |= same & more
            same &= of(c).eqNullSafe(F.lit(v))
        return out

    def page_files(self, after: tuple | None, size: int) -> list[str]:
        """The files that a page of that size after these keys lies in."""
        left = self.files if after is None else self.files.filter(self._beyond(after, "high"))
        begin = left.agg(F.min(F.col("before") + F.when(F.lit(after is None), 0).otherwise(F.col("rows")))).first()[0]  # past the first file, of which some rows may be left
        return [] if begin is None else [r.file for r in left.filter(F.col("before") < begin + size).orderBy("before").collect()]

    def page(self, after: tuple | None, size: int) -> DataFrame:
        """The next rows after the ones with these keys (the first ones, without)."""
        names = self.page_files(after, size)
        if not names:
            return self.rows.filter("false").drop("at")
        rows = self.rows.sparkSession.read.schema(self.rows.schema).parquet(*names)
        kept = rows if after is None else rows.filter(self._beyond(after))
        return kept.orderBy("at").limit(size).drop("at")

    def page_at(self, offset: int, size: int) -> DataFrame:
        """The rows from a place on."""
        inside = (F.col("before") < offset + size) & (F.col("before") + F.col("rows") > offset)
        found = self.files.filter(inside).orderBy("before").collect()  # files of one page
        if not found:
            return self.rows.filter("false").drop("at")
        rows = self.rows.sparkSession.read.schema(self.rows.schema).parquet(*[r.file for r in found])
        return rows.orderBy("at").limit(offset - found[0].before + size).offset(offset - found[0].before).drop("at")

    def numbered(self, name: str = "seq") -> DataFrame:
        """The rows with their place in the order, from 0."""
        spots = self.files.select(F.col("file").alias("_f"), (F.col("before") - F.col("first_at")).alias("_shift"))
        rows = self.rows.withColumn("_f", F.input_file_name()).join(spots, "_f")
        return rows.withColumn(name, F.col("at") + F.col("_shift")).drop("at", "_f", "_shift")


def arrange(df: DataFrame, keys: list[str], path: str, file_rows: int = FILE_ROWS) -> Ordered:
    """Writes df in the order of its keys, and the table of files."""
    order = [F.col(c).asc_nulls_first() for c in keys]
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    key = F.struct(*keys)
    ends = rows.groupBy(F.input_file_name().alias("file")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("rows"), F.min_by(key, "at").alias("low"), F.max_by(key, "at").alias("high"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("first_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over files
    ends.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")
    return opened(df.sparkSession, path, keys)


def opened(spark: SparkSession, path: str, keys: list[str]) -> Ordered:
    return Ordered(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/files"), keys)
