"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking by the vectors.

A rotation for balanced binary codes is learned (centre, principal axes, then alternating code and rotation updates)
on at most `sample` vectors, chosen by the least hash of their id: a documented bound. It is learned for the
`fitted_lengths` most frequent lengths of vectors; rarer lengths have codes by a fixed rotation, and lose no vector.
Every vector is encoded. Each table keys the codes by some of their bits (dealt by seeded permutations), within one
label and one length. The bits of a key grow with the vectors of the largest label, so that lists stay short, and the
number of tables grows so that a pair at the threshold still meets in one of them with the same probability.

What meets in a list is first compared by its codes: only vectors with another one within the Hamming radius (five
standard deviations above what a pair at the threshold has), that no earlier table brought together, go on. Their
vectors are fetched and compared by cosine in double precision; pairs at or over the threshold are links. Lists longer
than `list_rows` are compared block against block, codes and vectors alike. A task returns link counts and one edge
per linked vector, no pairs.

Null vectors, empty ones, zero ones and those with null or non-finite components link with nothing, nor does a null
label. Equal vectors of a label are one node with a weight; copies count as links of each other. Repeated rows are
copies. An empty table gives an empty result; extra columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, least_labels, settle, settle_table, sorted_groups


class ItqCoder:
    """Binary codes sign((x - mean) @ axes @ rotation) of at most 64 bits."""

    def __init__(self, x: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 7) -> None:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        n, d = x.shape
        if n < 4 * d:  # too few vectors to tell a centre and axes
            self.mean, vectors = np.zeros(d), np.eye(d)
        else:
            self.mean = x.mean(axis=0)
            vectors = np.linalg.eigh(np.cov(x - self.mean, rowvar=False, bias=True).reshape(d, d))[1][:, ::-1]
        self.axes = vectors[:, : min(bits, d)]
        v = (x - self.mean) @ self.axes
        rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1],) * 2))
        for _ in range(rounds):
            code = np.where(v @ rotation >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(code.T @ v)
            rotation = (u @ w).T
        self.turn = self.axes @ rotation

    def bits(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return (x - self.mean) @ self.turn >= 0


def key_sizes(vectors: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, number of tables) for so many vectors of one label: about eight vectors a list if codes are
    balanced, 12 bits at least, and tables until a pair at the threshold misses all with probability 0.008."""
    bits = max(12, int(np.ceil(np.log2(max(vectors, 2)))) - 3)
    agree = 1 - np.arccos(threshold) / np.pi
    return bits, int(np.ceil(np.log(0.008) / np.log1p(-(agree**bits))))


def table_masks(n_bits: int, tables: int, key_bits: int, seed: int = 11) -> np.ndarray:
    """Which bits each table looks at: permutations of all bits, cut into keys. Short codes have short keys."""
    rng, rows = np.random.default_rng(seed), []
    key_bits = max(1, min(min(12, n_bits // 4) + max(0, key_bits - 12), n_bits // 2))
    while len(rows) < tables:
        order = rng.permutation(n_bits)
        rows += [order[i : i + key_bits] for i in range(0, n_bits - key_bits + 1, key_bits)]
    return np.array([np.bitwise_or.reduce(np.left_shift(np.uint64(1), r.astype(np.uint64))) for r in rows[:tables]])


def packed(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _new_pairs(xor: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which pairs, given by the exclusive or of their codes, meet in none of the tables of these masks."""
    met = np.zeros(len(xor), bool)
    for m in masks:
        met |= xor & m == 0
    return ~met


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _distinct_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("id"), v.cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    merged = rows.groupBy("label", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    return settle_table(merged.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))


def _links(nodes: DataFrame, threshold: float, key_bits: int | None, tables: int | None, sample: int, list_rows: int, fitted_lengths: int) -> DataFrame:
    """(node, links, root) parts: link counts found in one list, and a linked node of the same list."""
    spark = nodes.sparkSession
    most = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    grown = key_sizes(most, threshold)
    key_bits, tables = key_bits or grown[0], tables or grown[1]
    coders = {}
    for dim, _ in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(fitted_lengths).collect():
        some = nodes.filter(F.col("dim") == dim).orderBy(F.xxhash64("first"), "first").limit(sample).select("v").toPandas()["v"]
        coders[dim] = ItqCoder(np.stack(some.to_numpy()).astype(np.float64))
    sent = spark.sparkContext.broadcast(coders)  # a matrix of at most 64 columns for each of these lengths
    label = nodes.schema["label"].dataType.simpleString()
    off = np.arccos(threshold) / np.pi

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = {}
        for b in batches:
            dims = b.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                coder = sent.value.get(dim) or plain.setdefault(dim, ItqCoder(np.ones((1, dim))))
                bits = coder.bits(_matrix(part.column(2)))
                code, masks = packed(bits), table_masks(bits.shape[1], tables, key_bits)
                n, t = len(code), len(masks)
                each = pa.array(np.repeat(np.arange(n), t))
                cols = [part.column(0).take(each), part.column(3).take(each), part.column(1).take(each), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array((code[:, None] & masks).ravel().view(np.int64)), pa.array(np.repeat(code, t).view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["node", "label", "dim", "t", "key", "code"])

    keyed = settle_table(nodes.select("node", "dim", "v", "label").mapInArrow(encode, f"node long, label {label}, dim int, t int, key long, code long"))
    by = ["label", "dim", "t", "key"]
    lists = settle(keyed.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").withColumn("g", F.monotonically_increasing_id()))
    blocks = F.ceil(F.col("n") / list_rows)
    met = keyed.join(lists, by).select("g", "dim", "t", "node", "code", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    pair = (F.least("block", "other") * (1 << 32) + F.greatest("block", "other")).alias("pair")
    order = ["g", pair, "block", "dim", "t", "node", "code"]

    def tables_before(dim: int, t: int) -> np.ndarray:
        return table_masks(min(64, dim), tables, key_bits)[:t]

    def by_code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, 2):
            pairs, block, dims, ts, codes = (table.column(i).to_numpy() for i in (1, 2, 3, 4, 6))
            codes, keep = codes.view(np.uint64), []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                c, n_bits = codes[lo:hi], min(64, int(dims[lo]))
                radius, before = n_bits * off + 5 * np.sqrt(n_bits * off * (1 - off)), tables_before(int(dims[lo]), int(ts[lo]))
                cross = pairs[lo] >> 32 != pairs[lo] & 0xFFFFFFFF
                near = np.zeros(hi - lo, bool)
                for i in range(0, hi - lo, 256):
                    xor = c[i : i + 256, None] ^ c[None, :]
                    close = np.bitwise_count(xor) <= radius
                    close[np.arange(len(xor)), np.arange(i, i + len(xor))] = False
                    if cross:
                        close &= block[lo + i : lo + i + len(xor), None] != block[None, lo:hi]
                    a, b = np.nonzero(close)
                    new = _new_pairs(xor[a, b], before)
                    near[i + a[new]] = near[b[new]] = True
                keep.append(np.flatnonzero(near) + lo)
            if keep:
                yield from table.take(pa.array(np.concatenate(keep))).to_batches()

    kind = "g long, pair long, block long, dim int, t int, node long, code long"
    close = settle_table(met.select(*order).repartition("g", "pair").sortWithinPartitions("g", "pair").mapInArrow(by_code, kind))

    def by_vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, 2):
            pairs, block, dims, ts, ids, codes, copies = (table.column(i).to_numpy() for i in range(1, 8))
            codes = codes.view(np.uint64)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x = _matrix(table.column(8).slice(lo, hi - lo))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if pairs[lo] >> 32 != pairs[lo] & 0xFFFFFFFF:
                    linked &= block[lo:hi, None] != block[None, lo:hi]
                a, b = np.nonzero(linked)
                if not len(a):
                    continue
                c, before = codes[lo:hi], tables_before(int(dims[lo]), int(ts[lo]))
                new = np.concatenate([_new_pairs(c[a[i : i + 65536]] ^ c[b[i : i + 65536]], before) for i in range(0, len(a), 65536)])
                counts = np.bincount(a[new], weights=copies[lo:hi][b[new]], minlength=hi - lo).astype(np.int64)
                root = least_labels(linked)
                some = np.flatnonzero(linked.any(axis=1))
                mine = ids[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array(mine[some]), pa.array(counts[some]), pa.array(mine[root[some]])], names=["node", "links", "root"])

    fetched = close.join(nodes.select("node", "copies", "v"), "node").select("g", "pair", "block", "dim", "t", "node", "code", "copies", "v")
    return settle(fetched.repartition("g", "pair").sortWithinPartitions("g", "pair").mapInArrow(by_vector, "node long, links long, root long"))


def link_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, tables: int | None = None, key_bits: int | None = None, sample: int = 8192, list_rows: int = 1024, fitted_lengths: int = 64) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each input row. tables and key_bits follow from the number of
    vectors unless they are given."""
    nodes = _distinct_vectors(df, id_col, vector_col, label_col)
    parts = _links(nodes, threshold, key_bits, tables, sample, list_rows, fitted_lengths)
    links = parts.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(parts.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "_node")
    rooted = settle(nodes.select("node", "first", "copies").join(links, "node", "left").join(roots, F.col("node") == F.col("_node"), "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    of = settle(nodes.select("node", F.col("label").alias("_label"), F.col("v").alias("_v")).join(rooted.join(named, "root").select("node", "n_links", "component"), "node").drop("node"))
    rows = df.select(F.col(id_col), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    out = rows.join(of, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component", id_col)
    return out.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col(id_col)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force: every pair within a label, then the links' closure.
OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.seen FROM reach r JOIN links l ON r.node = l.a),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN least ON least.node = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = v.vec_id
"""
