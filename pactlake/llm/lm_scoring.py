"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Words are white-space-separated runs of the lower-cased text, each text ends in one end token. Four passes:

1. Counts of all words of the training texts, exact, by a shuffle on the word. The most frequent of at most 64 bytes,
   `head` of them, are held by the executors, so what is broadcast is bounded. The number of training tokens sets the
   number of classes of the model: the root of `fill` times it. The most frequent words are a class each, all others
   share the last quarter of the classes by a hash of the word. None of this depends on how the table is partitioned.
2. Neighbouring classes (previous, next) of all training texts, a sparse table with at most `fill` times as many rows as
   there are tokens; and the words outside the head of all texts, which meet their counts.
3. Training. The model gives class w after class c the probability softmax(context[c] . target[w] + bias[w]). The
   objective is noise-contrastive estimation with the unigram distribution as noise, taken in expectation rather than
   drawn. It is a sum over pairs of classes, so with the targets given every context is a problem of its own, and the
   other way round: tasks take contexts, then targets, in turn, by Newton steps on dense blocks of at most `cells`
   pairs. Only the vectors go through the driver. The last turn adds each context's normaliser over all classes.
4. Scores, from the numbers of each text's words, which the counts left behind. A word that shares its class has that class's probability times its add-half share among the words there.

The base score is the add-half unigram score over all words, end token included.

A null text counts as empty (one end token). Repeated rows are scored each on its own. A null id counts as crc32 of
the empty text, that is as training. An empty table gives an empty result; extra columns of the input are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, settle_table

END = 0


class LogBilinearModel(NamedTuple):
    """P(w | c) over classes; each is float32, `classes` long."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    log_z: np.ndarray

    def log10(self, c: np.ndarray, w: np.ndarray, batch: int = 1 << 17) -> float:
        """The sum of log10 P(w[i] | c[i])."""
        total = 0.0
        for i in range(0, len(c), batch):
            a, b = c[i : i + batch], w[i : i + batch]
            s = np.einsum("ij,ij->i", self.context[a], self.target[b]) + self.bias[b] - self.log_z[a]
            total += float(s.sum(dtype=np.float64))
        return total / math.log(10)


def refine(x: np.ndarray, y: np.ndarray, real: np.ndarray, noise: np.ndarray, offset: np.ndarray, prior: float, steps: int) -> np.ndarray:
    """Newton steps for each row of x on sum(real * log s + noise * log(1 - s)) - prior / 2 * x . x.

    s = sigmoid(x . y + offset) is the chance that a pair is a real one, with `real` and `noise` the weights of both.
    """
    x, both, d = x.copy(), real + noise, x.shape[1]
    i, j = np.triu_indices(d)
    for _ in range(steps):
        s = 1 / (1 + np.exp(-np.clip(x @ y.T + offset, -30, 30)))
        g = (real - both * s) @ y - prior * x
        curve = both * s * (1 - s)
        # Second derivatives of all rows at once: one product with the products of y's columns, a slice of y at a time.
        flat = np.zeros((len(x), len(i)))
        for at in range(0, len(y), 4096):
            part = y[at : at + 4096]
            flat += curve[:, at : at + 4096] @ (part[:, i] * part[:, j])
        second = np.empty((len(x), d, d))
        second[:, i, j] = second[:, j, i] = flat
        step = np.linalg.solve(second + prior * np.eye(d), g[..., None].astype(np.float64))[..., 0]
        x += step * np.minimum(1.0, 2 / (np.linalg.norm(step, axis=1, keepdims=True) + 1e-9)).astype(x.dtype)
    return x


def _half(table: DataFrame, own: np.ndarray, other: np.ndarray, seen: np.ndarray, of_targets: bool, noise: int, prior: float, steps: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """One turn: new vectors (a target's last number is its bias) for the rows of the table, and contexts' normalisers."""
    q = ((seen + 0.5) / (seen.sum() + 0.5 * len(seen))).astype(np.float32)
    sent = table.sparkSession.sparkContext.broadcast((own, other, seen.astype(np.float32), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other, seen, q = sent.value
        v, held, wide = len(seen), [], max(1, cells // len(seen))

        def solved() -> pa.RecordBatch:
            rows = np.array([r for r, _, _ in held])
            real = np.zeros((len(held), v), np.float32)
            for i, (_, at, n) in enumerate(held):
                real[i, np.frombuffer(at, np.int32)] = np.frombuffer(n, np.float32)
            held.clear()
            if of_targets:
                y = np.hstack([other, np.ones((v, 1), np.float32)])
                x = refine(own[rows], y, real, noise * q[rows, None] * seen, np.float32(-math.log(noise)), prior, steps)
                z = np.zeros(len(rows))
            else:
                y, bias = other[:, :-1], other[:, -1]
                x = refine(own[rows], y, real, noise * seen[rows, None] * q, bias - np.float32(math.log(noise)), prior, steps)
                z = _log_sum((x @ y.T).astype(np.float32) + bias + np.log(q))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary()), pa.array(z, pa.float64())], names=["row", "vector", "z"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == wide:
                    yield solved()
        if held:
            yield solved()

    own, z = own.copy(), np.zeros(len(seen))
    if not of_targets:
        z[:] = _log_sum((other[:, -1] + np.log(q))[None, :])[0]  # a context that never occurs keeps the zero vector
    for row, vector, log_z in table.mapInArrow(run, "row long, vector binary, z double").collect():  # a row for each class
        own[row], z[row] = np.frombuffer(vector, np.float32), log_z
    sent.unpersist()
    return own, z


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True, dtype=np.float64)))[:, 0]


def _packed(pairs: DataFrame, row: str, column: str, blocks: int, chunk: int = 1 << 20) -> DataFrame:
    """(row, at, n): for each row its columns (int32) and counts (float32), packed: 8 bytes a pair, few rows to shuffle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def pieces() -> pa.RecordBatch:
            r, at, n = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            order = np.argsort(r, kind="stable")
            r, at, n = r[order], at[order].astype(np.int32), n[order].astype(np.float32)
            starts = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            offsets = pa.py_buffer((np.append(starts, len(r)) * 4).astype(np.int32))
            parts = (pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x)]) for x in (at, n))
            return pa.RecordBatch.from_arrays([pa.array(r[starts]), *parts], names=["row", "at", "n"])

        for batch in batches:
            if batch.num_rows:
                waiting.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size > chunk:
                yield pieces()
                size = 0
        if waiting:
            yield pieces()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row's pieces lie side by side; together they have no more pairs than there are classes."""
        now, at, n = None, [], []
        for batch in batches:
            out = []
            for r, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != now and at:
                    out.append((now, b"".join(at), b"".join(n)))
                    at, n = [], []
                now = r
                at.append(x)
                n.append(y)
            if out:
                yield whole(out)
        if at:
            yield whole([(now, b"".join(at), b"".join(n))])

    def whole(rows: list) -> pa.RecordBatch:
        r, at, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["row", "at", "n"])

    schema = "row long, at binary, n binary"
    cut = pairs.select(F.col(row).cast("long"), F.col(column).cast("long"), F.col("n").cast("double")).mapInArrow(pack, schema)
    return settle_table(cut.repartition(blocks, "row").sortWithinPartitions("row").mapInArrow(join, schema))


def train(pairs: DataFrame, classes: int, dim: int = 32, noise: int = 16, turns: int = 2, steps: int = 2, prior: float = 3.0, cells: int = 1 << 21, seed: int = 3) -> LogBilinearModel:
    """The model of neighbour counts (a, b, n), b after a, over classes 0 to classes - 1."""
    # Every token is the next of one pair and the previous of another, so one vector of counts serves both sides.
    seen = np.zeros(classes, np.float64)
    for at, n in pairs.groupBy("b").agg(F.sum("n")).collect():  # a row for each class
        seen[at] = n
    blocks = -(-(classes**2) // cells)
    by = [_packed(pairs, a, b, blocks) for a, b in ("ab", "ba")]
    context = np.zeros((classes, dim), np.float32)
    target = np.random.default_rng(seed).normal(0, 0.3, (classes, dim + 1)).astype(np.float32)
    target[:, -1] = 0
    target[seen == 0] = 0
    context, z = _half(by[0], context, target, seen, False, noise, prior, steps, cells)
    for _ in range(turns):
        target, _ = _half(by[1], target, context, seen, True, noise, prior, steps, cells)
        context, z = _half(by[0], context, target, seen, False, noise, prior, steps, cells)
    q = (seen + 0.5) / (seen.sum() + 0.5 * classes)
    for table in by:
        drop_table(table)
    return LogBilinearModel(context, np.ascontiguousarray(target[:, :-1]), (target[:, -1] + np.log(q)).astype(np.float32), z.astype(np.float32))


def _words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()


def _texts(batch: pa.RecordBatch, i: int) -> Iterator[bytes | None]:
    column = batch.column(i).cast(pa.binary())
    return (column[j].as_py() for j in range(len(column)))


def word_counts(training: DataFrame, offer: int) -> DataFrame:
    """(word, n): all words of the texts; the empty word stands for the end tokens. A task hands on its counts when it
    holds more than `offer` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            counts[b""] += b.num_rows
            for raw in _texts(b, 0):
                counts.update(_words(raw))
                if len(counts) > offer:
                    yield told()
        yield told()

    return settle_table(training.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0"))


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fill: float = 1.0, most_classes: int = 1 << 17, head: int = 1 << 17, offer: int = 1 << 19) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    `most_classes` bounds what is broadcast (264 bytes a class); beyond it more words share each of the last classes.
    """
    spark = df.sparkSession
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    counts = word_counts(docs.filter(~F.col("held")), offer)
    real = F.col("word") != F.lit(b"")
    train_tokens, ends, vocabulary = (x or 0 for x in counts.agg(F.sum("n"), F.sum(F.when(~real, F.col("n"))), F.count("*")).first())
    top = counts.filter(real & (F.octet_length("word") <= 64)).orderBy(F.desc("n"), "word").limit(head).collect()  # at most head rows
    words, ones = [bytes(r.word) for r in top], np.array([ends, *(r.n for r in top), 0], np.int64)
    # Number 0 is the end token, the last one any word outside the head.
    sent = spark.sparkContext.broadcast(words)  # at most head * 64 bytes
    size, other = len(words) + 2, len(words) + 1
    classes = min(most_classes, max(8, math.isqrt(int(fill * train_tokens))))
    shared = max(1, classes // 4)
    exact = min(classes - shared, other)
    classes = exact + shared

    def numbers() -> tuple[dict[bytes, int], np.ndarray]:
        """Of each head word its number; of each number its class."""
        of = np.arange(size)
        of[exact:other] = [exact + crc32(w) % shared for w in sent.value[exact - 1 :]]
        return {w: i for i, w in enumerate(sent.value, 1)}, of

    def read(split: list[bytes], number: dict[bytes, int], of: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Numbers and classes of the words, and where the words outside the head are."""
        at = np.fromiter((number.get(w, other) for w in split), np.int64, len(split))
        c, rare = of[at], np.flatnonzero(at == other).tolist()
        c[rare] = [exact + crc32(split[j]) % shared for j in rare]
        return at, c, rare

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, of = numbers()
        codes, waiting = [], 0

        def rows(kind: int, a: list | np.ndarray, **given: list | np.ndarray) -> pa.RecordBatch:
            types = {"word": pa.binary(), "n": pa.int64(), "tokens": pa.binary()}
            cols = [pa.array(given[k], t) if k in given else pa.nulls(len(a), t) for k, t in types.items()]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a, pa.int64()), *cols], names=["kind", "a", *types])

        def neighbours() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_counts=True)
            codes.clear()
            return rows(2, found, n=n)

        for batch in batches:
            ids, keys, found, n, tokens = batch.column(0).to_numpy(), [], [], [], []
            for i, (raw, held) in enumerate(zip(_texts(batch, 1), batch.column(2).to_pylist(), strict=True)):
                split = _words(raw)
                at, c, outside = read(split, number, of)
                tokens.append(np.where(at == other, size + c, at).astype(np.int32).tobytes())
                if not held:
                    codes.append(np.append(END, c) * classes + np.append(c, END))
                    waiting += len(c) + 1
                rare = Counter(split[j] for j in outside)
                keys += [ids[i]] * len(rare)
                found += rare.keys()
                n += rare.values()
            yield rows(3, ids, tokens=tokens)
            if keys:
                yield rows(0, keys, word=found, n=n)
            if waiting > 1 << 21:
                yield neighbours()
                waiting = 0
        yield neighbours()

    numbered = settle_table(docs.withColumn("row", F.monotonically_increasing_id()))
    counted = settle_table(numbered.select("row", "text", "held").mapInArrow(count, "kind int, a long, word binary, n long, tokens binary"))
    codes = counted.filter("kind = 2").groupBy(F.col("a").alias("code")).agg(F.sum("n").alias("n"))
    pairs = settle_table(codes.select(F.expr(f"code div {classes}").alias("a"), (F.col("code") % classes).alias("b"), "n"))
    model = train(pairs, classes)
    drop_table(pairs)
    # Rare words: every occurrence meets its count in the training texts.
    rare = counted.filter("kind = 0").select("word", F.col("a").alias("row"), "n")
    # Of the words that share a class: their tokens, and how many they are; those with a class of their own taken off.
    n_shared, v_shared = np.zeros(shared), np.zeros(shared)
    for i, n, v in counts.filter(real).groupBy((F.crc32("word") % shared).alias("i")).agg(F.sum("n"), F.count("*")).collect():  # at most `shared` rows
        n_shared[i], v_shared[i] = n, v
    alone = [crc32(w) % shared for w in words[: exact - 1]]
    np.subtract.at(n_shared, alone, ones[1:exact])
    np.subtract.at(v_shared, alone, 1)
    z_shared = np.append(np.zeros(exact), np.log10(n_shared + 0.5 * (v_shared + 1)))
    per_row = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0))).groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
    base_z = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))
    tables = spark.sparkContext.broadcast((np.log10(ones + 0.5), ones > 0, z_shared, tuple(model)))  # `classes` vectors and `head` numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, of), (logs, seen, z_shared, parts) = numbers(), tables.value
        model = LogBilinearModel(*parts)
        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                token = np.frombuffer(raw, np.int32)
                rare = token >= size
                at = np.where(rare, other, token)
                c = np.where(rare, token - size, of[at])
                model_log = model.log10(np.append(END, c), np.append(c, END)) - float(z_shared[c].sum())
                headed = at[at != other]
                sharing = headed[headed >= exact]
                out.append((len(token) + 1, int(seen[headed].sum()) + int(seen[END]), float(logs[headed].sum() + logs[END]), model_log + float(logs[sharing].sum())))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=["row", "n_tokens", "head_known", "head_log", "head_score"])

    scored = counted.filter("kind = 3").select("a", "tokens").mapInArrow(score, "row long, n_tokens long, head_known long, head_log double, head_score double")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0).cast("long"))
    out = numbered.select("row", F.col("id").alias(id_col), F.col("held").alias("held_out")).join(scored.join(per_row, "row", "left"), "row")
    return out.select(id_col, "held_out", "n_tokens", (F.col("head_known") + rare_known).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("head_log") + rare_log - F.col("n_tokens") * base_z).alias("base_score"), (F.col("head_score") + rare_log).alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
