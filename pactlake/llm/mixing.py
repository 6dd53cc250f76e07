"""Mixing sources to target weights by Pfair scheduling.

Documents of a source form blocks. With weight w, block j of a source may be released at slot floor(j / w) and is due
before slot ceil((j + 1) / w); earliest-deadline-first places every block in its window, so after any number t of
slots each source has had w * t blocks, give or take less than one. The weights are taken as they are, as fractions,
never rounded to a period, so nothing drifts however long the schedule is, and every source has a lane of its own.
When a source runs out, the others go on with their weights scaled up; each such phase starts its windows anew. Each
slot depends on the one before: one task works out the schedule, a row for each block, and the blocks find their slots
by a join with it. That task takes in a row for each source and holds no more than one batch of the schedule.

Target weights may be given; otherwise they are the sources' document counts to the power `temper`. Every document
gets one position; none is dropped or repeated. A null source is a source of its own. A source without a weight gets
the least given one; sources of weight zero come after all others, in equal parts. Repeated rows are placed each on
its own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import batched
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import numbered, settle

_SLOT_ROW = "source string, lane long, phase long, block long, slot long, release long, due long"
_FAR = (1 << 63) - 1


def schedule(blocks: list[int], weights: list[float | Fraction]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(lane, phase, block, slot, release, due) of all blocks by slot: earliest deadline first among released blocks.

    A phase ends when a lane runs out. Lanes that have had no block in a phase wait in `heirs`, by falling weight, that
    is by rising deadline, so that a new phase costs nothing for them.
    """
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("negative weight")
    unit = lcm(*(w.denominator for w in exact))
    share = [int(w * unit) for w in exact]
    left, had, start, phase = list(blocks), [0] * len(blocks), 0, 0
    for lanes in ([i for i, n in enumerate(left) if n and share[i]], [i for i, n in enumerate(left) if n and not share[i]]):
        for i in lanes:
            share[i] = share[i] or 1
        heirs = sorted(lanes, key=lambda i: (-share[i], i))
        after, before = dict(zip([None, *heirs], [*heirs, None], strict=True)), dict(zip([*heirs, None], [None, *heirs], strict=True))
        total = sum(share[i] for i in lanes)
        while total:
            waiting: list[tuple[int, int, int]] = []  # (release, lane, block of the phase)
            ready: list[tuple[int, int, int]] = []  # (due, lane, block of the phase)
            fresh, slot, over = after[None], 0, False
            while not over:
                while waiting and waiting[0][0] <= slot:
                    _, lane, j = heapq.heappop(waiting)
                    heapq.heappush(ready, (-(-(j + 1) * total // share[lane]), lane, j))
                if fresh is not None and (not ready or -(-total // share[fresh]) < ready[0][0]):
                    due, lane, j = -(-total // share[fresh]), fresh, 0
                    fresh = after[fresh]
                else:
                    due, lane, j = heapq.heappop(ready)
                assert due > slot
                yield lane, phase, had[lane], start + slot, start + j * total // share[lane], min(start + due, _FAR)
                had[lane] += 1
                left[lane] -= 1
                slot += 1
                over = not left[lane]
                if not over:
                    heapq.heappush(waiting, ((j + 1) * total // share[lane], lane, j + 1))
            after[before[lane]], before[after[lane]] = after[lane], before[lane]
            total -= share[lane]
            start += slot
            phase += 1


def slots(lanes: DataFrame, weights: Mapping[str | None, float] | None, block_rows: int, temper: float, batch_rows: int = 8192) -> DataFrame:
    """The schedule as rows, from (source, rows, lane): one task, which reads a row for each source."""
    least = min(weights.values()) if weights else None

    def plan(batches):
        own = sorted((r["lane"], r["source"], r["rows"]) for b in batches for r in b.to_pylist())
        names = [name for _, name, _ in own]
        goal = [weights.get(name, least) if weights else rows**temper for _, name, rows in own]
        for some in batched(schedule([-(-rows // block_rows) for *_, rows in own], goal), batch_rows):
            cols = list(zip(*some, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in cols[0]], pa.string()), *(pa.array(c, pa.int64()) for c in cols)], _SLOT_ROW.replace(",", "").split()[::2])

    return lanes.coalesce(1).mapInArrow(plan, _SLOT_ROW)


def mix(df: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = 32, temper: float = 0.7, whole_rows: bool = False, broadcast_blocks: int = 500_000) -> DataFrame:
    """(id, source, lane, phase, block, slot, release, due, position), one row for each input row, and with whole_rows
    the input row as struct _row. Positions rise with the slots; inside a block they follow the documents' numbers in
    their lane. Slots follow the exact weights, and no lane is shared."""
    counts = df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("rows"))
    by_size = Window.orderBy(F.desc("rows"), F.col("source").asc_nulls_first())
    lanes = settle(counts.withColumn("lane", F.row_number().over(by_size).cast("long") - 1))  # a row for each source
    table = settle(slots(lanes, dict(weights) if weights else None, block_rows, temper))
    table = F.broadcast(table) if table.count() <= broadcast_blocks else table
    row = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source")] + [F.struct("*").alias("_row")] * whole_rows
    dealt = numbered(df.select(*row), ["_source"], ["_id", "_source"], "_i").withColumn("_block", F.expr(f"_i div {block_rows}"))
    placed = dealt.join(table, F.col("_source").cast("string").eqNullSafe(F.col("source")) & (F.col("_block") == F.col("block")))
    position = F.col("slot") * block_rows + F.col("_i") % block_rows
    return placed.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("lane").cast("int").alias("lane"), F.col("phase").cast("int").alias("phase"), "block", "slot", "release", "due", position.alias("position"), *["_row"] * whole_rows)


def in_mixed_order(df: DataFrame, **more) -> DataFrame:
    """The rows of df in the order of their positions, with their own columns only."""
    return mix(df, whole_rows=True, **more).select("position", "_row").sort("position").select("_row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))
