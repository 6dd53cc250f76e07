"""SimHash near-duplicates by an inverted index over byte positions with count filtering.

A fingerprint has 8 bytes. Two that differ in at most 3 bits share at least 5 of the 8 positional bytes. Posting
lists keyed by one positional byte would hold 1/256 of all fingerprints each, so lists are keyed by three positional
bytes out of positions 0-3 or out of 4-7: five shared positions always include three on one side, so every link
meets in some list. A list longer than `posting` is refined by two more positional bytes (all ten choices, which
again keeps every link); what is still longer is compared block by block. In a list, shared positional bytes are
tallied for each pair, pairs that reach 5 are kept, and their bits are compared. A task returns one edge per linked
fingerprint (to the smallest of its group), never all pairs.

Exact and equal fingerprints are one node from the start. A null text counts as empty; texts without words have
fingerprint zero and are linked like any other. Repeated rows stay repeated. Null ids stay rows, but don't name a
component. An empty table gives an empty result; extra columns of the input are left out (keep_one keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free_name, least_labels, settle, sorted_groups

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
MAX_BITS, SHARED = 3, 5
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(raw: bytes, k: int = 3, seed: int = 42) -> int:
    """64 bits; bit i is 1 if set in over half the XXH64 of the k-word shingles. bytes.split and bytes.lower work on
    ASCII, so this needs no decoding."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(k, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = 3) -> DataFrame:
    """(id, fp long), one row for each input row; the bits are those of the unsigned fingerprint."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(texts[i].as_py() or b"", k) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _value(fp: Column, positions: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("long")
    for i in positions:
        out = out * 256 + _byte(fp, i)
    return out


def _refined(t: int) -> list[tuple[int, int]]:
    return list(combinations([i for i in range(8) if i not in TRIPLES[t]], 2))


def link_edges(fps: DataFrame, posting: int = 2048) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints connected by links. fps: distinct values in column fp."""
    fp = F.col("fp")
    lists = fps.select("fp", F.explode(F.array(*(F.lit(t << 24) + _value(fp, p) for t, p in enumerate(TRIPLES)))).alias("g"))
    sizes = settle(lists.groupBy("g").count().filter("count > 1"))
    sized = lists.join(sizes, "g")
    short = sized.filter(F.col("count") <= posting).select("g", F.lit(0).cast("long").alias("pair"), F.lit(0).alias("block"), "fp")
    if sizes.filter(F.col("count") > posting).limit(1).count():
        t = F.shiftright("g", 24)
        finer = F.lit(None)
        for i in range(8):
            finer = F.when(t == i, F.array(*((F.col("g") * 16 + (j + 1)) * 65536 + _value(fp, p) for j, p in enumerate(_refined(i))))).otherwise(finer)
        fine = sized.filter(F.col("count") > posting).select("fp", F.explode(finer).alias("g"))
        fine_sizes = settle(fine.groupBy("g").count().filter("count > 1"))
        blocks = F.ceil(F.col("count") / posting).cast("int")
        own = F.pmod(F.xxhash64(F.col("fp"), F.lit(7)), blocks.cast("long")).cast("int")
        dealt = fine.join(fine_sizes, "g").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        pair = F.least("block", "other").cast("long") * (1 << 32) + F.greatest("block", "other")
        short = short.unionByName(dealt.select("g", pair.alias("pair"), "block", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, 2):
            values, blocks, pairs = table.column(3).to_numpy().view(np.uint64), table.column(2).to_numpy(), table.column(1).to_numpy()
            out_a, out_b = [], []
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                v = values[lo:hi]
                if len(v) < 2:
                    continue
                cross = pairs[lo] >> 32 != pairs[lo] & 0xFFFFFFFF
                linked = _linked(v, blocks[lo:hi] if cross else None)
                if linked.any():
                    label = least_labels(linked)
                    hit = np.flatnonzero(label != np.arange(len(v)))
                    out_a.append(v[hit])
                    out_b.append(v[label[hit]])
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (out_a, out_b)], names=["a", "b"])

    return short.repartition("g", "pair").sortWithinPartitions("g", "pair").mapInArrow(run, "a long, b long").distinct()


def _linked(v: np.ndarray, blocks: np.ndarray | None) -> np.ndarray:
    """Which pairs share enough positional bytes and differ in few enough bits; with blocks, only pairs across."""
    out = np.zeros((len(v), len(v)), bool)
    for i in range(0, len(v), 256):
        x = v[i : i + 256, None] ^ v[None, :]
        shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
        some = shared >= SHARED
        out[i : i + 256][some] = np.bitwise_count(x[some]) <= MAX_BITS
    np.fill_diagonal(out, False)
    if blocks is not None:
        out &= blocks[:, None] != blocks[None, :]
    return out


def group_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, posting: int = 2048) -> DataFrame:
    """(id, fingerprint of 16 hex digits, component_id), one row for each input row."""
    rows = settle(fingerprints(df, id_col, text_col, k))
    nodes = settle(rows.groupBy("fp").agg(F.min(id_col).alias("_first")))
    roots = components(link_edges(nodes.select("fp"), posting))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    of = settle(rooted.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "component_id"))
    return rows.join(of, F.col("fp") == F.col("_fp")).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One document of each group with all its columns: the one with the smallest id; of repeated rows with that
    id, one. Rows with a null id have no name to be grouped by and stay."""
    grouped = group_near(df, id_col, text_col, **more)
    name = free_name(df)
    drop = settle(grouped.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct())
    left = df.join(drop, df[id_col] == F.col(name), "left_anti")
    named = left.filter(F.col(id_col).isNotNull())
    again = settle(named.groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(name))
    if not again.limit(1).count():
        return left
    once = named.join(again, F.col(id_col) == F.col(name), "left_semi").dropDuplicates([id_col])
    return left.join(again, F.col(id_col) == F.col(name), "left_anti").unionByName(once)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_near(spark.read.parquet(f"{sf_dir}/documents.parquet"))
