"""Removal of repeated 200-byte strings, with deep-shallow sorting of suffixes.

A byte is removed if some 200-byte string that covers it also starts at another place, in the same text or another.

1. Equal texts of 200 bytes or more are one class; a class of several texts goes whole. One text of each class stays
   for comparison with others.
2. Anchors: of the k-byte strings inside every 200-byte window, those with the least hash. Two equal windows have the
   same anchors, so only suffixes at anchors whose hash occurs twice need sorting, about one in 70 bytes before that.
3. Around such an anchor, a window takes L bytes from the left and 200 - k - L from the right. Within a group of equal
   anchors, the suffixes that start at the anchor and the reversed prefixes that end there are each put in order:
   multikey quicksort to a shallow depth, then blind tries for the groups that still agree. Longest common prefixes of
   neighbours tell for each occurrence the widest stretch shared with any other through windows over this anchor.
   Occurrences with equal surroundings share all their windows; one of them stands for all in its group.
4. Groups over `block` different surroundings are dealt to pairs of blocks; beyond `most_blocks` blocks, windows are
   counted by digest instead, which is linear in the group and just as exact.

Stretches of one text are united at the end. Null texts count as empty; texts under 200 bytes stay as they are.
Repeated rows are copies of each other. An empty table gives an empty result; extra columns of the input are left out
(without_repeats keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, free_name, settle, settle_table, sorted_groups

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CHUNK = 1 << 19


def _sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over x[i : i + w] for every i with a whole window."""
    n = len(x) - w + 1
    y = np.concatenate([x, np.repeat(x[-1:], -len(x) % w)]).reshape(-1, w)
    ahead = op.accumulate(y, axis=1).ravel()
    behind = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


class AnchorFinder:
    """Positions whose k-byte string has the least hash in some window of `length` bytes."""

    def __init__(self, length: int = 200, k: int = 64) -> None:
        self.length, self.k = length, k
        with np.errstate(over="ignore"):
            ones = np.full(_CHUNK + 4 * length, _BASE, np.uint64)
            ones[0] = 1
            self.up = np.cumprod(ones)
            ones[1:] = _UNDO
            self.down = np.cumprod(ones)

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) in a stretch of texts that end at `ends`."""
        n, k, w = len(data), self.k, self.length - self.k + 1
        if n < self.length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
            x = (total[k:] - total[:-k]) * self.down[: n - k + 1]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        x |= np.uint64(1)
        least = _sliding(np.minimum, x, w)
        starts = np.concatenate([[0], ends[:-1]])
        whole = np.zeros(len(least) + 1, np.int32)
        last = np.maximum(starts, ends - self.length + 1)
        long = last > starts
        whole[starts[long]] += 1
        whole[last[long]] -= 1
        least[np.cumsum(whole[:-1]) == 0] = 0
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        at = np.flatnonzero(_sliding(np.maximum, padded, w) == x)
        return at, x[at]

    def find(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text numbers, positions, hashes) of texts data[offsets[i] : offsets[i + 1]], stretch by stretch."""
        i, n = 0, len(offsets) - 1
        while i < n:
            lo = offsets[i]
            j = int(np.searchsorted(offsets, lo + _CHUNK, side="right")) - 1
            if j > i:
                at, x = self._chunk(data[lo : offsets[j]], offsets[i + 1 : j + 1] - lo)
                text = np.searchsorted(offsets, at + lo, side="right") - 1
                yield text, at + lo - offsets[text], x
                i = j
                continue
            size, seen = int(offsets[i + 1] - lo), -1  # a text longer than a stretch: overlapping pieces
            for a in range(0, max(1, size - self.length + 1), _CHUNK):
                piece = data[lo + a : min(lo + a + _CHUNK + self.length - 1, offsets[i + 1])]
                at, x = self._chunk(piece, np.array([len(piece)]))
                new = at + a > seen
                at, x = at[new] + a, x[new]
                seen = int(at[-1]) if len(at) else seen
                yield np.full(len(at), i), at, x
            i += 1


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _blind_trie(texts: list[bytes], items: list[int], out: list[int]) -> None:
    """Append items in the order of their texts. Inner nodes are (depth, {byte: child}) and hold no text: the way
    down is taken blindly by single bytes, one comparison with the text found there tells where to branch."""
    leaf = lambda i: (None, [i])
    root = leaf(items[0])
    for i in items[1:]:
        s, node = texts[i], root
        while node[0] is not None:
            d = node[0]
            c = s[d] if d < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = texts[node[1][0]]
        split = common_prefix(s, other)
        if split == len(s) == len(other):
            node[1].append(i)
            continue
        parent, key, node = None, None, root
        while node[0] is not None and node[0] < split:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        c = s[split] if split < len(s) else -1
        if node[0] == split:
            node[1][c] = leaf(i)
            continue
        inner = (split, {(other[split] if split < len(other) else -1): node, c: leaf(i)})
        if parent is None:
            root = inner
        else:
            parent[1][key] = inner
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def deep_shallow_order(texts: list[bytes], shallow: int = 32, step: int = 8) -> list[int]:
    """Numbers of the texts in their order."""
    out: list[int] = []
    stack = [(list(range(len(texts))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
        elif depth >= shallow:
            _blind_trie(texts, items, out)
        else:
            pivot = texts[items[len(items) // 2]][depth : depth + step]
            less, same, more = [], [], []
            for i in items:
                w = texts[i][depth : depth + step]
                (same if w == pivot else less if w < pivot else more).append(i)
            stack += [(more, depth), (same, depth + step if len(pivot) == step else shallow), (less, depth)]
    return out


def shared_stretches(left: list[bytes], right: list[bytes], k: int, length: int) -> list[tuple[int, int] | None]:
    """For each occurrence of an anchor: how far left of it and right of its start (at most) some `length`-byte window
    over it goes that another occurrence has too. left: reversed bytes before the anchor; right: from its start on."""
    m, need = len(left), length - k
    if m == 2:
        a, b = common_prefix(left[0], left[1]), common_prefix(right[0], right[1])
        return [(a, b)] * 2 if b >= k and a + b >= length else [None] * 2
    orders = [deep_shallow_order(x) for x in (left, right)]
    near = [np.array([0] + [common_prefix(x[i], x[j]) for i, j in zip(o, o[1:], strict=False)]) for x, o in zip((left, right), orders, strict=True)]
    ranks = [np.empty(m, np.int64), np.empty(m, np.int64)]
    for rank, o in zip(ranks, orders, strict=True):
        rank[o] = np.arange(m)
    tries = np.unique(np.concatenate([near[0], length - near[1], [0, need]]))
    far_left, far_right = np.full(m, -1), np.full(m, -1)
    for take in tries[(tries >= 0) & (tries <= need)]:
        of_left = np.cumsum(near[0] < take)[ranks[0]]
        of_right = np.cumsum(near[1] < length - take)[ranks[1]]
        _, where, counts = np.unique(of_left * (m + 1) + of_right, return_inverse=True, return_counts=True)
        hit = counts[where] > 1
        far_left[hit] = np.maximum(far_left[hit], take)
        far_right[hit] = np.maximum(far_right[hit], length - take)
    return [(int(a), int(b)) if a >= 0 else None for a, b in zip(far_left, far_right, strict=True)]


def _anchor_table(classes: DataFrame, length: int, k: int) -> DataFrame:
    """(a, c, tid, pos, l, r): the anchor's hash, a digest of its surroundings, its text and place, and how many bytes
    of surroundings lie to its left and from its start on."""
    reach = length - k
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = None
        for b in batches:
            finder = finder or AnchorFinder(length, k)
            texts = b.column(1).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            raw = memoryview(data)
            for text, at, x in finder.find(data, offsets):
                left, right = np.minimum(at, reach), np.minimum(offsets[text + 1] - offsets[text] - at, length)
                begin = offsets[text] + at
                stretch = zip((begin - left).tolist(), (begin + right).tolist(), left.tolist(), strict=True)
                c = np.fromiter((digest(raw[i:j], n) for i, j, n in stretch), np.uint64, len(at))
                cols = (x.view(np.int64), c.view(np.int64), b.column(0).to_numpy()[text], at.astype(np.int64), left.astype(np.int32), right.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["a", "c", "tid", "pos", "l", "r"])

    return classes.select("tid", "text").mapInArrow(run, "a long, c long, tid long, pos long, l int, r int")


def _surroundings(touched: DataFrame, length: int, k: int) -> DataFrame:
    reach = length - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, marked = b.column(1).cast(pa.binary()), b.column(2)
            for i in range(len(texts)):
                raw, marks, tid = texts[i].as_py(), marked[i].values, b.column(0)[i].as_py()
                if marks is None or not len(marks):
                    continue
                at = marks.field("pos").to_pylist()
                yield pa.RecordBatch.from_arrays([marks.field("a"), marks.field("n"), pa.array([tid] * len(at), pa.int64()), marks.field("pos"), pa.array([raw[max(0, p - reach) : p][::-1] for p in at], pa.binary()), pa.array([raw[p : p + k + reach] for p in at], pa.binary())], names=["a", "n", "tid", "pos", "left", "right"])

    return touched.select("tid", "text", "marks").mapInArrow(run, "a long, n long, tid long, pos long, left binary, right binary")


def _spans_in_groups(around: DataFrame, length: int, k: int, block: int) -> DataFrame:
    """(tid, lo, hi) from groups of equal anchors, dealt to pairs of blocks where they are large."""
    blocks = F.ceil(F.col("n") / block)
    small = around.filter(F.col("n") <= block).select("a", F.lit(0).cast("long").alias("pair"), "tid", "pos", "left", "right")
    own = F.pmod(F.xxhash64("tid", "pos"), blocks)
    large = around.filter(F.col("n") > block).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    pair = F.least("own", "other") * (1 << 32) + F.greatest("own", "other")
    large = large.filter((F.col("own") != F.col("other")) | (blocks == 1)).select("a", pair.alias("pair"), "tid", "pos", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, 2):
            tids, at = table.column(2).to_numpy(), table.column(3).to_numpy()
            lefts, rights = table.column(4).to_pylist(), table.column(5).to_pylist()
            index, lo, hi = [], [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                for i, found in enumerate(shared_stretches(lefts[s:e], rights[s:e], k, length), s):
                    if found:
                        index.append(i)
                        lo.append(int(at[i]) - found[0])
                        hi.append(int(at[i]) + found[1])
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(tids[index]), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=["tid", "lo", "hi"])

    return small.unionByName(large).repartition("a", "pair").sortWithinPartitions("a", "pair").mapInArrow(run, "tid long, lo long, hi long")


def _spans_by_digest(around: DataFrame, length: int, k: int) -> DataFrame:
    """(tid, lo, hi) for anchors with very many different surroundings: windows are counted by digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, tid, pos, left, right in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                whole, n = left[::-1] + right, len(left)
                takes = [t for t in range(min(n, length - k) + 1) if n - t + length <= len(whole)]
                found = [hashlib.blake2b(whole[n - t : n - t + length], digest_size=16).digest() for t in takes]
                m = len(takes)
                yield pa.RecordBatch.from_arrays([pa.array([a] * m, pa.int64()), pa.array([tid] * m, pa.int64()), pa.array([pos] * m, pa.int64()), pa.array(takes, pa.int64()), pa.array(found, pa.binary())], names=["a", "tid", "pos", "take", "window"])

    windows = settle_table(around.select("a", "tid", "pos", "left", "right").mapInArrow(run, "a long, tid long, pos long, take long, window binary"))
    key = ["a", "take", "window"]
    twice = settle(windows.groupBy(*key).count().filter("count > 1").select(*key))
    shared = windows.join(twice, key).groupBy("tid", "pos").agg(F.max("take").alias("l"), F.min("take").alias("r"))
    return shared.select("tid", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") - F.col("r") + length).alias("hi"))


def _cut(touched: DataFrame, spans: DataFrame) -> DataFrame:
    """(h, removed, spans, sha, kept) of the texts that lose bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            rows = []
            for i in range(len(texts)):
                raw, found = texts[i].as_py(), b.column(2)[i].values
                lo, hi = found.field("lo").to_numpy(), np.minimum(found.field("hi").to_numpy(), len(raw))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                first = np.concatenate([[True], lo[1:] > hi[:-1]])
                begin, end = lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(hi) - 1)]
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
                rows.append((b.column(0)[i].as_py(), int((end - begin).sum()), len(begin), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["h", "removed", "spans", "sha", "kept"])

    per = spans.groupBy("tid").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    return touched.filter("copies = 1").select("tid", "h", "text").join(per, "tid").select("h", "text", "found").mapInArrow(run, "h binary, removed long, spans long, sha string, kept string")


def find_repeats(df: DataFrame, text_col: str = "text", length: int = 200, k: int = 64, block: int = 1024, most_blocks: int = 16) -> DataFrame:
    """(h, removed, spans, sha, kept) for each different text that loses bytes; h is the SHA-256 of the text. Texts
    with copies have removed = -1, for all."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    long = df.select(F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("h"), text).filter(F.octet_length("text") >= length)
    merged = long.groupBy("h").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    classes = settle_table(merged.withColumn("tid", F.monotonically_increasing_id()))
    anchors = settle_table(_anchor_table(classes, length, k))
    # Anchors that occur twice; mixed: not all with equal surroundings.
    seen = anchors.groupBy("a").agg(F.count("*").alias("n"), (F.min("c") != F.max("c")).alias("mixed"))
    twice = settle(seen.filter("n > 1").select("a", "mixed"))
    again = settle_table(anchors.join(twice, "a"))
    drop_table(anchors)
    # Equal surroundings are merged: their windows are shared as wide as they go, one of them stands for all.
    kinds = settle(again.filter("mixed").groupBy("a", "c").agg(F.count("*").alias("same"), F.min(F.struct("tid", "pos")).alias("one")))
    whole = again.filter(~F.col("mixed")).select("tid", "pos", "l", "r")
    # A very common passage makes one (a, c) hot: a sort-merge join is what Spark splits by skew.
    alike = kinds.filter("same > 1").select("a", "c")
    whole = whole.unionByName(again.filter("mixed").join(alike.hint("merge"), ["a", "c"]).select("tid", "pos", "l", "r"))
    whole = whole.select("tid", (F.col("pos") - F.col("l")).alias("lo"), (F.col("pos") + F.col("r")).alias("hi"))
    sizes = settle(kinds.groupBy("a").agg(F.count("*").alias("n")))
    marks = kinds.select("a", "one.tid", "one.pos").join(sizes, "a").groupBy("tid").agg(F.collect_list(F.struct("a", "pos", "n")).alias("marks"))
    met = again.select("tid").distinct().join(marks, "tid", "left")
    touched = settle_table(classes.join(met, "tid"))
    around = _surroundings(touched, length, k)
    spans = whole.unionByName(_spans_in_groups(around.filter(F.col("n") <= block * most_blocks), length, k, block))
    if sizes.filter(F.col("n") > block * most_blocks).limit(1).count():
        spans = spans.unionByName(_spans_by_digest(around.filter(F.col("n") > block * most_blocks), length, k))
    spans = settle_table(spans)
    drop_table(again)
    cut = _cut(touched, spans)
    copied = classes.filter("copies > 1").select("h", F.lit(-1).cast("long").alias("removed"), F.lit(1).cast("long").alias("spans"), F.sha2(F.lit(""), 256).alias("sha"), F.lit("").alias("kept"))
    out = settle_table(cut.unionByName(copied))
    for done in (touched, spans, classes):
        drop_table(done)
    return out


def repeat_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), one row for each input row."""
    found = find_repeats(df, text_col, **more).drop("kept").withColumnRenamed("h", "_found")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("_h"))
    out = rows.join(found, F.col("_h") == F.col("_found"), "left")
    removed = F.when(F.col("removed") < 0, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0).cast("long")))
    return out.select(id_col, "n_bytes", removed.alias("n_removed"), F.coalesce("spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", F.lower(F.hex("_h"))).alias("kept_sha256"))


def without_repeats(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", **more) -> DataFrame:
    """All rows and columns of df, with the repeated bytes taken out of the text (and the count of characters after
    it). Where a cut splits a character, the rest of that character goes too. Null texts stay null."""
    cols = df.columns
    key, hit, kept = (free_name(df, like) for like in ("_h", "_found", "_kept"))
    found = find_repeats(df, text_col, **more).select(F.col("h").alias(hit), F.col("kept").alias(kept))
    keyed = df.withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    out = keyed.join(found, F.col(key) == F.col(hit), "left")
    new = F.coalesce(kept, text_col)
    put = {text_col: new}
    if chars_col in cols:
        put[chars_col] = F.when(F.col(kept).isNull(), F.col(chars_col)).otherwise(F.length(kept).cast(df.schema[chars_col].dataType))
    return out.select(*(put.get(c, F.col(c)).alias(c) for c in cols))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
