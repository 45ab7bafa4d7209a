"""Stored forms of a list that answer deep pages and key lookups from a few files.

``write_pages`` cuts a list, in page order, into range chunks and keeps how many
rows lie before each; page n then reads the one or two chunks it falls into,
however deep it is.  ``write_lookup`` sorts by a key and adds Parquet Bloom
filters, so a lookup skips the row groups that cannot hold the keys.

Defined cases: ties of the sort column follow the id, NULLs stand where the
database puts them (first descending, last ascending); a value that a third of
the rows share is cut into chunks by the id; repeated rows each take a place; a
page past the end and a key nobody has give no rows; an empty list gives empty
pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.util import checked_column, pg_order

S = F.col


def _order(sort: str, direction: str, id_col: str) -> list[Column]:
    return [pg_order(sort, "desc" if str(direction).lower() == "desc" else "asc"), S(id_col).asc()]


def write_pages(df: DataFrame, base: str, sort: str, direction: str = "DESC", chunks: int = 200,
                id_col: str = "id", allowed=None) -> None:
    """Write ``df`` for paging in order of (``sort``, id): one range exchange.

    ``<base>/rows`` holds a folder a chunk; ``<base>/index`` one row a chunk: its
    rows and the rows before it (chunks are numbered in page order).  Choose
    ``chunks`` so that one holds about a file's worth of rows.
    """
    checked_column(sort, allowed or df.columns)
    if "__chunk" in df.columns:
        raise ValueError("the column name __chunk is taken by the index")
    (df.repartitionByRange(chunks, *_order(sort, direction, id_col))
     .withColumn("__chunk", F.spark_partition_id())
     .write.partitionBy("__chunk").parquet(f"{base}/rows"))
    spark = df.sparkSession
    # one row a chunk: the running sum goes over the index, never over the rows
    counts = _rows(spark, base, df.schema).groupBy("__chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    (counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).coalesce(1)
     .withColumn("row", F.lit(None).cast(df.schema)).write.parquet(f"{base}/index"))


def _rows(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    chunked = StructType(schema.fields + [StructField("__chunk", IntegerType())])
    return spark.read.schema(chunked).parquet(f"{base}/rows")


def read_page(spark: SparkSession, base: str, sort: str, direction: str = "DESC", page_no: int = 1,
              limit: int = 20, id_col: str = "id") -> DataFrame:
    """Page ``page_no`` (from 1) of a list stored with the same order.

    The index names the chunks; partition pruning keeps the others unread.
    """
    if page_no < 1 or limit < 1:
        raise ValueError("page and limit count from 1")
    index = spark.read.parquet(f"{base}/index")
    start = (page_no - 1) * limit
    hit = (index.filter((S("before") < F.lit(start + limit)) & (S("before") + S("n") > F.lit(start)))
           .select("__chunk", "before").collect())
    schema = index.schema["row"].dataType
    skip = start - min((r.before for r in hit), default=start)
    rows = _rows(spark, base, schema).filter(S("__chunk").isin([r["__chunk"] for r in hit]))
    return rows.drop("__chunk").orderBy(*_order(sort, direction, id_col)).offset(skip).limit(limit)


def write_lookup(df: DataFrame, path: str, key: str, files: int = 200, row_group_bytes: int = 32 << 20) -> None:
    """Write ``df`` sorted by ``key`` with a Bloom filter of it in every row group."""
    (df.repartitionByRange(files, key).sortWithinPartitions(key).write
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option("parquet.block.size", str(row_group_bytes)).parquet(path))


def lookup_keys(df: DataFrame, key: str, values: list) -> DataFrame:
    """Rows whose key is one of ``values``, a bounded list of a request.

    An OR of equalities reaches the reader at any length, where a long IN list
    would be pushed as its least and greatest value only.
    """
    cond = F.lit(False)
    for v in dict.fromkeys(v for v in values if v is not None):
        cond = cond | (S(key) == F.lit(v))
    return df.filter(cond)
