"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space that separates words in every operator here (space, \t, \n, \v, \f, \r).
ASCII_SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is settled needs its shuffle files no more: Spark removes them when the action ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def free_name(df: DataFrame, like: str = "_key") -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(n for i in range(len(taken) + 1) if (n := f"{like}{i}") not in taken)


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; lost executors don't cost what came before it."""
    shared_dir(df.sparkSession)
    with _shuffles_dropped(df.sparkSession):
        return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """The same as settle for wide rows: a compressed columnar table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of settle_table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, group: list[str], order: list[str], to: str, shard_rows: int = 512, along: str | None = None, stretch: int = 4096) -> DataFrame:
    """Add column `to`: consecutive numbers from 0 within each group, without one task per group.

    Rows of a group are dealt to shards by a hash of the order columns, numbered inside each shard, and lifted by
    the rows in the shards before. Equal rows get different numbers; which of them gets which doesn't matter. The
    order is by shard, then by the order columns, the same on every run. With `along`, a column of whole numbers that
    few rows share, numbers rise with it: the shards are ranges of it.
    """
    if along:
        shard, order = F.expr(f"coalesce({along}, 0) div {shard_rows}"), [along, *order]
    else:
        shard = F.pmod(F.xxhash64(*order), F.lit(max(1, -(-df.count() // shard_rows))))
    dealt = df.withColumns({"_group": F.to_json(F.struct(*group)), "_shard": shard})
    # Sums before a shard in two steps, so that no task holds all shards of a group: before its stretch, and within it.
    sizes = settle(dealt.groupBy("_group", "_shard").count().withColumn("_stretch", F.expr(f"_shard div {stretch}")))
    ahead = lambda *by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    stretches = sizes.groupBy("_group", "_stretch").agg(F.sum("count").alias("rows"))
    stretches = stretches.select("_group", "_stretch", F.coalesce(F.sum("rows").over(ahead("_group", order="_stretch")), F.lit(0)).alias("_first"))
    within = sizes.withColumn("_inside", F.coalesce(F.sum("count").over(ahead("_group", "_stretch", order="_shard")), F.lit(0)))
    offsets = settle(within.join(stretches, ["_group", "_stretch"]).select("_group", "_shard", (F.col("_first") + F.col("_inside")).alias("_upto")))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_group", "_shard").orderBy(*order)))
    return ranked.join(offsets, ["_group", "_shard"], "left").withColumn(to, F.col("_upto") + F.col("_rank") - 1).select(*df.columns, to)


def stored_order(df: DataFrame) -> Column:
    """Where a row of df, a Parquet table that Spark wrote, stands in it: whole numbers that rise in the order of writing.
    A column of df's own named _metadata doesn't matter.

    Files are named after their partition, part-00012-..., and then the file in it, -c003; a file that is not is first.
    """
    of = df.metadataColumn("_metadata")
    number = lambda pattern: F.coalesce(F.regexp_extract(of["file_name"], pattern, 1).try_cast("long"), F.lit(0))
    return F.shiftleft(number(r"^part-(\d+)"), 42) + F.shiftleft(number(r"-c(\d+)[.]"), 32) + of["row_index"]


def sorted_groups(batches, n_keys: int):
    """Tables of whole groups from sorted Arrow batches: rows that agree in the first n_keys columns stay together.

    What is held at once is a batch and one group. Yields (table, starts): group i is rows starts[i] to starts[i+1].
    """
    held: list[pa.RecordBatch] = []

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for i in range(n_keys):
            key = t.column(i).to_numpy()
            new[1:] |= key[1:] != key[:-1]
        return np.append(np.flatnonzero(new), len(t))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        starts = starts_of(t)
        if len(starts) > 2:
            last = int(starts[-2])
            yield t.slice(0, last), starts[:-1]
            held = t.slice(last).to_batches()
    if held and sum(b.num_rows for b in held):
        t = pa.Table.from_batches(held)
        yield t, starts_of(t)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix, the smallest index in each row's connected component."""
    n = len(linked)
    label = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list: root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each round is settled, so that
    plans stay short; neither edges nor labels go through the driver, only a count and a checksum.
    """

    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("mu", "m").alias("m"))
        least = settle(least)
        linked = both.join(least, F.col("u") == F.col("mu"))
        if large:
            out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("mu").alias("u"), F.col("m").alias("v")))
        return out.filter(F.col("u") > F.col("v")).distinct()

    lo, hi = F.least(a, b), F.greatest(a, b)
    e = settle(edges.filter(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    sign = lambda d: tuple(d.agg(F.count("*"), F.coalesce(F.sum(F.hash("u", "v").cast("long")), F.lit(0))).first())
    seen = sign(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        e = settle(stars(stars(e, True), False))
        now = sign(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
