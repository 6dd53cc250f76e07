"""Hard negatives: for an anchor and a positive, the most similar vectors of other labels that stay below the positive.

Scores are integer inner products of vectors whose components became floor(scale * x). Anchors are a stated query set;
they meet all rows in cells: anchors are dealt to `R` rows and vectors to `C` columns of a grid, so that a cell holds a
bounded number of both, and each side is copied only as often as the grid has cells across. A cell multiplies tiles by
Strassen's recursion on int64 with zero padding and keeps heaps: the first `k` of each anchor. Heaps of cells merge by
Spark's limited ranking, which keeps the first `k` of each task before its shuffle. Two passes, because the window of a
negative depends on the score of its positive:

1. Positives: the first `k` other rows of the anchor's label.
2. Windows: for each anchor and positive, the first `k` rows of other labels with a score in the window.

A null id can't be named and takes no part, nor does a row with a null label, a null vector or a component that is null
or not finite. Vectors of different lengths meet as if the shorter one ended in zeros. Components beyond 64 bits become
the nearest number of 64 bits, and scores beyond 64 bits wrap; all others are exact, also where sums in between wrap.
Rows with the same id are different rows: each is an anchor of its own and may be another one's positive or negative.
An empty table gives an empty result; extra columns of the input are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle_table

_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = 32) -> np.ndarray:
    """a @ b on int64: seven products of half the size at each step, until a side is no longer than `leaf`. Odd sides
    are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        return strassen(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    a11, a12, a21, a22 = a[: m // 2, : k // 2], a[: m // 2, k // 2 :], a[m // 2 :, : k // 2], a[m // 2 :, k // 2 :]
    b11, b12, b21, b22 = b[: k // 2, : n // 2], b[: k // 2, n // 2 :], b[k // 2 :, : n // 2], b[k // 2 :, n // 2 :]
    both = strassen(a11 + a22, b11 + b22, leaf)
    low, right = strassen(a21 + a22, b11, leaf), strassen(a11, b12 - b22, leaf)
    left, top = strassen(a22, b21 - b11, leaf), strassen(a11 + a12, b22, leaf)
    out = np.empty((m, n), np.int64)
    out[: m // 2, : n // 2] = both + left - top + strassen(a12 - a22, b21 + b22, leaf)
    out[: m // 2, n // 2 :] = right + top
    out[m // 2 :, : n // 2] = low + left
    out[m // 2 :, n // 2 :] = both - low + right + strassen(a21 - a11, b11 + b12, leaf)
    return out


class Heaps:
    """For each of `n` queries the first `k` offers: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(n, _LEAST)  # the score of the k-th so far

    def offer(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, first: int = 0) -> None:
        """Scores of queries first, first + 1, ... (rows) against ids (columns), where allowed."""
        i, j = np.nonzero(allowed & (scores >= self.floor[first : first + len(scores), None]))
        if not len(i):
            return
        query, score, ident = np.append(self.query, i + first), np.append(self.score, scores[i, j]), np.append(self.id, ids[j])
        order = np.lexsort((ident, ~score, query))  # ~x falls as x rises, without overflow
        query = query[order]
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        kept = order[place < self.k]
        self.query, self.score, self.id = query[place < self.k], score[kept], ident[kept]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.query[full]] = self.score[full]


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """(row, id, label, v): rows that take part; v are whole numbers, little-endian, of 2 or 8 bytes as they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(3):
                x = v.values
                if x.null_count or not np.isfinite(x := x.to_numpy(zero_copy_only=False).astype(np.float64)).all():
                    out.append(None)
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                whole = np.where(x >= 2.0**63, np.iinfo(np.int64).max, np.where(x < -(2.0**63), _LEAST, x.clip(-(2.0**63), 2.0**63 - 1024).astype(np.int64)))
                small = len(whole) == 0 or (whole.min() >= -(2**15) and whole.max() < 2**15)
                out.append((b"\x02" if small else b"\x08") + whole.astype("<i2" if small else "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["row", "id", "label", "v"])

    named = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).dropna()
    rows = named.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v")
    return settle_table(rows.mapInArrow(run, "row long, id long, label long, v binary").filter("v IS NOT NULL"))


def _matrix(packed: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(packed), width), np.int64)
    for i, raw in enumerate(packed):
        v = np.frombuffer(raw, "<i2" if raw[0] == 2 else "<i8", offset=1)
        out[i, : len(v)] = v
    return out


def _width(packed: list[bytes]) -> int:
    return max(((len(raw) - 1) // raw[0] for raw in packed), default=0)


def first_in_cells(anchors: DataFrame, rows: DataFrame, k: int, same_label: bool, cell: tuple[int, int] = (1 << 15, 1 << 17), tile: tuple[int, int] = (256, 2048)) -> DataFrame:
    """(row, slot, id, score, rank from 1): for each slot of an anchor the first k of all other rows with the same label,
    or with another label and a score in the slot's window. anchors: (row, label, v) and with windows (row, label, v, lo
    array<long>, hi array<long>), a slot for each pair; without windows the slot is 0."""
    n_anchors, n_rows = anchors.count(), rows.count()
    across = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // cell[1]))
    down = max(1, -(-n_anchors // cell[0]))
    windows = "lo" in anchors.columns
    own = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(down))
    column = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(across))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.withColumn("gr", own.cast("long")).withColumn("gc", spread(across))
    right = rows.select(*(F.col(c).alias(f"b_{c}") for c in ("row", "id", "label", "v")), spread(down).alias("b_gr"), column.cast("long").alias("b_gc"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            b = b.sort_by("b_id")
            va, vb = a.column("v").to_pylist(), b.column("b_v").to_pylist()
            width = max(_width(va), _width(vb))
            a_row, a_label, b_row, b_label, b_id = (t.column(c).to_numpy() for t, c in ((a, "row"), (a, "label"), (b, "b_row"), (b, "b_label"), (b, "b_id")))
            lo, hi = (a.column(c).to_pylist() for c in ("lo", "hi")) if windows else (None, None)
            slots = max(map(len, lo)) if windows else 1
            heaps = [Heaps(len(a), k) for _ in range(slots)]
            # A window that isn't there is empty: from the greatest number to the least.
            bounds = [(np.array([x[s] if s < len(x) else ~_LEAST for x in lo]), np.array([x[s] if s < len(x) else _LEAST for x in hi])) for s in range(slots)] if windows else None
            for at in range(0, len(b), tile[1]):
                y = np.ascontiguousarray(_matrix(vb[at : at + tile[1]], width).T)
                for up in range(0, len(a), tile[0]):
                    to = min(up + tile[0], len(a))
                    scores = strassen(_matrix(va[up:to], width), y)
                    equal = a_label[up:to, None] == b_label[None, at : at + tile[1]]
                    for s in range(slots):
                        if windows:
                            allowed = ~equal & (scores >= bounds[s][0][up:to, None]) & (scores <= bounds[s][1][up:to, None])
                        else:
                            allowed = (equal if same_label else ~equal) & (a_row[up:to, None] != b_row[None, at : at + tile[1]])
                        heaps[s].offer(scores, allowed, b_id[at : at + tile[1]], up)
            out = [(a_row[h.query], np.full(len(h.query), s, np.int32), h.id, h.score) for s, h in enumerate(heaps)]
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["row", "slot", "id", "score"])

    found = left.groupBy("gr", "gc").cogroup(right.groupBy("b_gr", "b_gc")).applyInArrow(run, "row long, slot int, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= k)


def mine_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k: int = 5, percent: int = 80, **more) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, a condition on the
    column id: the first k negatives of each of the anchor's first k positives, whose score is at least `percent` of the
    positive's and not above it."""
    rows = integer_vectors(df, id_col, vector_col, label_col)
    anchors = rows.filter(is_anchor)
    positives = settle_table(first_in_cells(anchors.select("row", "label", "v"), rows, k, True, **more).select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("hi")))
    # The least whole number s with percent * score <= 100 * s, in decimals that hold both products.
    wide = F.col("hi").cast("decimal(38,0)") * percent
    lo = F.when(F.col("hi") >= 0, F.ceil(wide / 100)).otherwise(F.lit(np.iinfo(np.int64).max)).cast("long")
    told = positives.withColumn("lo", lo).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))
    windowed = anchors.select("row", "label", "v").join(told, "row").select("row", "label", "v", F.transform("w", lambda x: x["lo"]).alias("lo"), F.transform("w", lambda x: x["hi"]).alias("hi"))
    negatives = first_in_cells(windowed, rows, k, False, **more)
    named = positives.join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
    met = negatives.join(named, ["row", "slot"])
    return met.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("hi").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table.withColumn("label", label), F.col("id") % 100 == 0)


OP12_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS ar, a.id AS aid, b.id AS bid, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0) AS BIGINT) AS s
  FROM rows a JOIN rows b ON a.r <> b.r WHERE a.id % 100 = 0),
positives AS (SELECT * FROM (SELECT ar, aid, bid, s, row_number() OVER (PARTITION BY ar ORDER BY s DESC, bid) AS slot FROM scores WHERE same) WHERE slot <= 5),
met AS (
  SELECT p.ar, p.aid, p.bid AS pid, p.slot, p.s AS ps, n.bid AS nid, n.s AS ns, row_number() OVER (PARTITION BY p.ar, p.slot ORDER BY n.s DESC, n.bid) AS rank
  FROM positives p JOIN scores n ON n.ar = p.ar AND NOT n.same WHERE 80 * p.s <= 100 * n.s AND 100 * n.s <= 100 * p.s)
SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score FROM met WHERE rank <= 5
"""
