"""Tables whose change jobs rewrite only the partitions that hold changed rows.

``<base>/data`` holds the rows, partitioned by one column.  Beside it lies what
finds a key's partitions without reading the rows: ``<base>/ranges`` (rows, least
and greatest key of a partition) and ``<base>/blooms`` (a blocked Bloom filter of
its keys: one word of 64 bits a key, four bits of it set; only words in use are
stored).  ``rewrite`` asks these, confirms the candidates by their key column,
runs the job on those partitions and swaps only partitions whose rows differ, so
files of the others stay as they are.

Defined cases: rows without a key stay but are never found by one; a key held by
several partitions is found in each; NULL is a partition like others (an empty
string is stored as NULL, Spark's own rule); a partition left without rows goes;
rows that change their partition leave the old and join the new one; an empty
batch rewrites nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import store

S = F.col
BITS_PER_KEY = 16
SET_BITS = 4


@dataclass
class Rewritten:
    """Partitions that were candidates, those rewritten, and what the job set aside."""

    asked: list
    rewritten: list
    rejects: DataFrame | None


def _word(key: Column, words: int) -> Column:
    """The word of a key; ``words`` is the same for all partitions of a table."""
    return F.pmod(F.xxhash64(F.lit("word"), key.cast("string")), F.lit(words))


def _mask(key: Column) -> Column:
    mask = F.lit(0).cast("long")
    h = F.xxhash64(F.lit("bits"), key.cast("string"))
    for i in range(SET_BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _ranges(df: DataFrame, partition: str, key: str) -> DataFrame:
    return df.groupBy(S(partition).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))


def _blooms(df: DataFrame, partition: str, key: str, words: int) -> DataFrame:
    """One row a partition and word in use; keys meet in a map-side aggregate."""
    return (df.filter(S(key).isNotNull())
            .groupBy(S(partition).alias("part"), _word(S(key), words).alias("word"))
            .agg(F.bit_or(_mask(S(key))).alias("bits")))


def _summarise(df: DataFrame, base: str, partition: str, key: str, words: int) -> None:
    """Write the summaries of the partitions in ``df``; other folders stay."""
    for name, rows in (("ranges", _ranges(df, partition, key)), ("blooms", _blooms(df, partition, key, words))):
        (rows.withColumn("at", F.hash("part")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("at").parquet(f"{base}/{name}"))


def write_keyed(df: DataFrame, base: str, partition: str, key: str) -> None:
    """Write a new table with its key summaries; the key's type should be one that orders.

    ``<base>/layout`` keeps the columns' types (folder names lose the partition
    column's) and the number of Bloom words, which is for good: a partition that
    outgrows it gives more candidates, never fewer.
    """
    spark = df.sparkSession
    _spread(df, partition).write.mode("errorifexists").partitionBy(partition).parquet(f"{base}/data")
    rows = spark.read.schema(df.schema).parquet(f"{base}/data")
    most = rows.groupBy(partition).count().agg(F.max("count")).first()[0] or 1
    words = 1 << (most * BITS_PER_KEY // 64).bit_length()
    (spark.range(1).select(F.lit(words).alias("words"), F.lit(None).cast(df.schema).alias("row"))
     .write.parquet(f"{base}/layout"))
    _summarise(rows, base, partition, key, words)


def _spread(df: DataFrame, partition: str) -> DataFrame:
    """Few files a partition; a large partition is split over tasks by its size."""
    return df.hint("rebalance", S(partition))


def _layout(spark: SparkSession, base: str) -> tuple[int, StructType]:
    layout = spark.read.parquet(f"{base}/layout")
    return layout.first().words, layout.schema["row"].dataType


def read_keyed(spark: SparkSession, base: str) -> DataFrame:
    """The table as it is now, in the types it was written with."""
    return spark.read.schema(_layout(spark, base)[1]).parquet(f"{base}/data")


def _summaries(spark: SparkSession, base: str, partition: str, key: str) -> tuple[DataFrame, DataFrame]:
    schema = _layout(spark, base)[1]
    part, kind = (schema[x].dataType.simpleString() for x in (partition, key))
    return (spark.read.schema(f"part {part}, n bigint, lo {kind}, hi {kind}").parquet(f"{base}/ranges"),
            spark.read.schema(f"part {part}, word bigint, bits bigint").parquet(f"{base}/blooms"))


def _is_one_of(col: Column, values: list) -> Column:
    """``col`` among ``values``, NULL counted as a value; prunes partitions."""
    known = [v for v in values if v is not None]
    cond = col.isin(known) if known else F.lit(False)
    return cond | col.isNull() if None in values else cond


def holding(spark: SparkSession, base: str, partition: str, key: str, keys: DataFrame) -> tuple[list, list]:
    """(partitions that may hold a key of the batch, partitions that do).

    The batch meets the Bloom words by the word's number, then the partition's
    range; what is left is confirmed on the key column of those partitions.  Only
    partition values reach the driver.
    """
    ranges, blooms = _summaries(spark, base, partition, key)
    words, schema = _layout(spark, base)
    # keys are hashed as the table holds them; what is no such value is nobody's key
    wanted = store(keys.select(S(key).try_cast(schema[key].dataType).alias("k")).filter(S("k").isNotNull()).distinct())
    asked = wanted.select("k", _word(S("k"), words).alias("w"), _mask(S("k")).alias("m"))
    near = (blooms.join(asked, (S("word") == S("w")) & (S("bits").bitwiseAND(S("m")) == S("m")))
            .select("part", "k"))
    spans = ranges.select(S("part").alias("p"), "lo", "hi")
    maybe = [r.part for r in near.join(spans, S("part").eqNullSafe(S("p"))
                                       & S("k").between(S("lo"), S("hi"))).select("part").distinct().collect()]
    rows = read_keyed(spark, base).filter(_is_one_of(S(partition), maybe))
    held = (rows.select(S(partition).alias("part"), S(key).alias("k")).join(wanted, "k", "left_semi")
            .select("part").distinct().collect())
    return maybe, [r.part for r in held]


def _fingerprints(df: DataFrame, partition: str) -> DataFrame:
    cols = sorted(df.columns)
    parts = [x for c in cols for x in (S(f"`{c}`"), S(f"`{c}`").isNull())]
    return df.select(S(partition).alias("part"), F.xxhash64(*parts).alias("h"), F.hash(*parts).alias("g"))


def _differing(old: DataFrame, new: DataFrame, partition: str) -> list:
    """Partitions whose rows (with their numbers of repeats) are not the same in both."""
    both = (_fingerprints(old, partition).withColumn("d", F.lit(-1))
            .unionByName(_fingerprints(new, partition).withColumn("d", F.lit(1))))
    odd = both.groupBy("part", "h", "g").agg(F.sum("d").alias("d")).filter(S("d") != 0)
    return [r.part for r in odd.select("part").distinct().collect()]


def _drop_folders(spark: SparkSession, folders: list[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def rewrite(spark: SparkSession, base: str, partition: str, key: str, batch: DataFrame,
            job: Callable) -> Rewritten:
    """Run a change job on the partitions that hold the batch's keys and swap what changed.

    ``job(rows)`` returns the new rows, or an object with ``state`` and
    ``rejects`` (:class:`ledgerflow.operators.changes.Applied`).  It may change or
    remove rows whose key the batch names, move them to other partitions, and add
    rows; columns stay those of the table.  New rows and rejects are stored before
    anything is swapped.  Each partition is swapped at the commit of one write; a
    job that fails before leaves the table as it was, one that fails between
    partitions is finished by running it again, if it sets values and does not
    count up.
    """
    maybe, held = holding(spark, base, partition, key, batch)
    table = read_keyed(spark, base)
    old = table.filter(_is_one_of(S(partition), held))
    done = job(old)
    state, rejects = (done, None) if isinstance(done, DataFrame) else (done.state, done.rejects)
    extra = set(state.columns) ^ set(table.columns)
    if extra:
        raise ValueError(f"the job changes the table's columns: {sorted(extra)}")
    new = store(state.select(*[S(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema.fields]))
    rejects = None if rejects is None else store(rejects)
    changed = _differing(old, new, partition)
    foreign = [p for p in changed if p not in held]
    if foreign:  # rows that moved into a partition the job has not read: it is rewritten whole
        new = store(new.unionByName(table.filter(_is_one_of(S(partition), foreign))))
    out = new.filter(_is_one_of(S(partition), changed))
    left = {r[0] for r in out.select(partition).distinct().collect()}
    emptied = [p for p in changed if p not in left]
    folders = [] if not emptied else [
        r.folder for r in table.filter(_is_one_of(S(partition), emptied))
        .select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct().collect()]
    if changed:
        (_spread(out, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(f"{base}/data"))
        _drop_folders(spark, folders)
        _refresh(spark, base, partition, key, changed)
    return Rewritten(maybe, changed, rejects)


def _refresh(spark: SparkSession, base: str, partition: str, key: str, changed: list) -> None:
    """Summaries of the changed partitions anew; they lie in folders by a hash of the
    value, so every partition of such a folder is read and empty folders go."""
    words, schema = _layout(spark, base)
    values = spark.createDataFrame([(p,) for p in changed], f"p {schema[partition].dataType.simpleString()}")
    slots = {r[0] for r in values.select(F.hash("p")).distinct().collect()}
    rows = read_keyed(spark, base).filter(F.hash(partition).isin(list(slots)))
    live = {r[0] for r in rows.select(F.hash(partition)).distinct().collect()}
    _summarise(rows, base, partition, key, words)
    _drop_folders(spark, [f"{base}/{x}/at={at}" for x in ("ranges", "blooms") for at in slots - live])
