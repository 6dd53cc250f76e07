"""Packing into optimal length buckets, then token-budget batches inside each bucket.

A document longer than max_len is cut into pieces of max_len tokens and a rest, so there are at most max_len distinct
lengths, and the histogram over all documents fits the driver by construction. Dynamic programming over it chooses the
bucket boundaries that minimise padding, exactly. With a `step` above 1, for hardware that wants aligned lengths, they
are rounded up to multiples of it first, and the boundaries are the best ones among those.
A batch of a bucket with boundary b holds budget // b pieces (at least one).

A null text counts as empty; a document without words is one piece of length 0. Repeated rows are packed each on its
own. An empty table gives an empty result; extra columns of the input are left out. With an `order`, pieces fill the
batches of their bucket in that order; otherwise in the order of a hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, settle


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries (among the lengths, ascending) of at most `buckets` buckets with the least padding."""
    order = np.argsort(lengths)
    v, c = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    upto = np.concatenate([[0], np.cumsum(c)])
    n, best, choice = len(v), None, []
    for k in range(min(buckets, n)):
        now, came = np.empty(n + 1, np.int64), np.zeros(n + 1, np.int64)
        now[0] = 0
        if k == 0:
            now[1:] = v * upto[1:]
        else:
            for j in range(1, n + 1):
                least = came[j - 1]  # the best cut never moves back as j grows
                cost = best[least:j] + v[j - 1] * (upto[j] - upto[least:j])
                came[j] = least + int(cost.argmin())
                now[j] = cost[came[j] - least]
        best = now
        choice.append(came)
    out, j = [], n
    for came in reversed(choice):
        if j == 0:
            break
        out.append(int(v[j - 1]))
        j = int(came[j])
    return out[::-1]


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 8, budget: int = 65_536, max_len: int = 32_768, step: int = 1, length: Column | None = None, order: Column | None = None) -> DataFrame:
    """(id, piece, n_tokens, bucket, bucket_len, batch, place): piece p of a document stands at `place` of a batch of
    its bucket; every batch but a bucket's last is full."""
    n = length if length is not None else word_count(text_col)
    at = ["_at"] if order is not None else []
    docs = settle(df.select(F.col(id_col), n.alias("_n"), *[order.cast("long").alias(a) for a in at]))
    last = F.greatest(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {max_len}"))
    pieces = docs.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    tokens = F.when(F.col("piece") < last, F.lit(max_len).cast("long")).otherwise(F.col("_n") - last * max_len)
    pieces = pieces.select(id_col, "piece", tokens.alias("n_tokens"), *at).withColumn("_top", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / step)) * step)
    found = pieces.groupBy("_top").count().toPandas()  # at most max_len / step rows
    tops = optimal_boundaries(found["_top"].to_numpy(), found["count"].to_numpy(), buckets) or [step]
    bucket, top, room = F.lit(0), F.lit(tops[0]), F.lit(max(1, budget // tops[0]))
    for i, b in enumerate(tops[1:], 1):
        over = F.col("_top") > tops[i - 1]
        bucket, top, room = F.when(over, F.lit(i)).otherwise(bucket), F.when(over, F.lit(b)).otherwise(top), F.when(over, F.lit(max(1, budget // b))).otherwise(room)
    placed = pieces.select(id_col, "piece", "n_tokens", bucket.alias("bucket"), top.alias("bucket_len"), room.cast("long").alias("_room"), *at)
    out = numbered(placed, ["bucket"], [id_col, "piece"], "_i", along="_at" if at else None)
    return out.select(id_col, "piece", "n_tokens", "bucket", "bucket_len", F.expr("_i div _room").alias("batch"), F.expr("_i % _room").alias("place"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
