"""Spelling variants grouped under their most frequent form, by blocked Gram matrices of letter counts.

Words are runs of the letters a-z and U+00C0 to U+00FF, A-Z lower-cased; some occurrences lose a letter by a hash of
document and run, so that variants exist. Four passes:

1. Counts: tasks count the words of whole texts, a shuffle adds them up. Words that are too short or rare go.
2. Blocks: words of one length lie together. A word's signature has a bit for each of `groups` groups of letters, the
   parity of how many of them it has. One changed letter turns two bits or none, an added or dropped one turns one, so
   blocks are cut by signatures (as coarse as the longest list needs) and only blocks that close are compared. A block
   of more than `block` words is dealt to several by a hash. Nothing is lost: every near pair meets in one cell.
3. Cells: two blocks of equal or adjacent lengths. Within, words of one full signature are multiplied with those of each
   signature that close: |x|^2 + |y|^2 - 2 X Y' is the squared distance of letter counts. Pairs at most two apart are
   verified letter by letter. A cell returns one row for each word that has near words in it, never the pairs.
4. Forms and roots: the best near word if it is `ratio` times as frequent; counts rise that much on every step, so chains
   are short and five doublings follow all of them.

A null text has no words; a null id counts as the empty text before the colon. Repeated rows count again. An empty table,
or one without words that are long and frequent enough, gives an empty result; extra columns of the input are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, settle_table, sorted_groups

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 7, drop_every: int = 31, held: int = 1 << 19) -> DataFrame:
    """(word, n) of words with at least min_len letters. A task holds `held` words at most and then hands them on."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_len},}}")  # shorter ones don't count, whole or cut

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                start = crc32(f"{key.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall((text.as_py() or "").translate(_LOWER))).items():
                    h = crc32(word.encode(), start)
                    if h % drop_every == 0:
                        i = h % len(word)
                        word = word[:i] + word[i + 1 :]
                        if len(word) < min_len:
                            continue
                    counts[word] += n
                if len(counts) > held:
                    yield told()
        yield told()

    found = df.select(F.col(id_col).cast("string"), text_col).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def signature(letters: np.ndarray, groups: int) -> np.ndarray:
    """Bit g: the parity of how many letters are of group g."""
    return np.bitwise_xor.reduce(np.int64(1) << (letters % groups).astype(np.int64), axis=1) if letters.size else np.zeros(len(letters), np.int64)


def _folded(sig: np.ndarray, groups: int, bits: int) -> np.ndarray:
    """A coarser signature: bit b is the parity of the bits g with g % bits = b."""
    out = np.zeros_like(sig)
    for g in range(groups):
        out ^= ((sig >> g) & 1) << (g % bits)
    return out


def _turns(bits: int, same_length: bool) -> list[int]:
    """How signatures of near words may differ."""
    one = [1 << g for g in range(bits)]
    return [0, *(a | b for a, b in combinations(one, 2))] if same_length else one


def near_pairs(x: np.ndarray, y: np.ndarray, groups: int, itself: bool, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of words in x and y that differ by exactly one edit; y has the length of x or one letter more. With
    itself, y is x and each pair comes once."""
    used = np.flatnonzero((np.bincount(x.ravel(), minlength=256) + np.bincount(y.ravel(), minlength=256)) > 0)
    column = np.zeros(256, np.intp)
    column[used] = np.arange(len(used))

    def ordered(letters: np.ndarray):
        sig = signature(letters, groups)
        order = np.argsort(sig, kind="stable")
        found, at = np.unique(sig[order], return_index=True)
        counts = np.zeros((len(letters), len(used)), np.float32)
        for j in range(letters.shape[1]):
            counts[np.arange(len(letters)), column[letters[order, j]]] += 1
        return order, counts, (counts * counts).sum(axis=1), found, np.append(at, len(order))

    xo, xc, xx, xs, xat = ordered(x)
    yo, yc, yy, ys, yat = (xo, xc, xx, xs, xat) if itself else ordered(y)
    where = {s: k for k, s in enumerate(ys.tolist())}
    left, right = [], []
    for a, s in enumerate(xs.tolist()):
        for turn in _turns(groups, x.shape[1] == y.shape[1]):
            b = where.get(s ^ turn)
            if b is None or (itself and b < a):
                continue
            for lo in range(xat[a], xat[a + 1], tile):
                hi = min(lo + tile, xat[a + 1])
                for at in range(yat[b], yat[b + 1], tile):
                    to = min(at + tile, yat[b + 1])
                    apart = xx[lo:hi, None] + yy[None, at:to] - 2 * (xc[lo:hi] @ yc[at:to].T)
                    i, j = np.nonzero(apart <= 2)
                    i, j = i + lo, j + at
                    if itself and a == b:
                        i, j = i[i < j], j[i < j]
                    left.append(i)
                    right.append(j)
    i, j = (np.concatenate([np.empty(0, np.intp), *side]) for side in (left, right))
    i, j = xo[i], yo[j]
    good = np.concatenate([np.empty(0, bool), *(_one_edit(x[i[k : k + (1 << 18)]], y[j[k : k + (1 << 18)]]) for k in range(0, len(i), 1 << 18))])
    return i[good], j[good]


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words of equal rows differ by one replaced letter, or y has one letter more."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    first = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    last = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return first + last >= x.shape[1]


def _best(words: np.ndarray, n: np.ndarray, of: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    """For each word that has near words: how many, and the most frequent, the smallest of equals."""
    rank = np.empty(len(words), np.intp)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], of))
    of, near = of[order], near[order]
    at = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.intp)
    text = lambda rows: pa.array([w.decode("latin-1") for w in words[rows].tolist()], pa.string())
    return pa.RecordBatch.from_arrays([text(of[at]), pa.array(np.diff(np.append(at, len(of)))), pa.array(n[near[at]]), text(near[at])], names=["word", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame, groups: int = 13, block: int = 1 << 14) -> DataFrame:
    """(word, n_near, best, best_n) for the words of (word, n) that have a near word; words are different."""
    most = vocabulary.groupBy(F.length("word")).count().agg(F.max("count")).first()[0] or 0
    bits = min(groups, 1 + max(0, (-(-most // block) - 1).bit_length()))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            sizes, keys = np.array([len(w) for w in words], np.int32), np.zeros(len(words), np.int64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                keys[at] = _folded(signature(_letters([words[i] for i in at], size), groups), groups, bits)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), batch.column(1), pa.array(sizes), pa.array(keys)], names=["word", "n", "len", "key"])

    words = settle_table(vocabulary.select("word", "n").mapInArrow(keyed, "word binary, n long, len int, key long"))
    sizes = settle(words.groupBy("len", "key").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")))
    # Cells: pairs of blocks that may hold near words, each once; a few for each block.
    turns = F.array(*(F.struct(F.lit(d).alias("longer"), F.lit(t).cast("long").alias("turn")) for d in (0, 1) for t in _turns(bits, d == 0)))
    met = sizes.select("len", "key", "chunks", F.explode(turns).alias("t"))
    met = met.select("len", "key", "chunks", (F.col("len") + F.col("t.longer")).alias("len2"), F.col("key").bitwiseXOR(F.col("t.turn")).alias("key2"))
    met = met.join(sizes.select(F.col("len").alias("len2"), F.col("key").alias("key2"), F.col("chunks").alias("chunks2")), ["len2", "key2"])
    chunk = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    met = met.withColumn("chunk", chunk("chunks")).withColumn("chunk2", chunk("chunks2"))
    met = met.filter((F.col("len") < F.col("len2")) | (F.col("key") < F.col("key2")) | ((F.col("key") == F.col("key2")) & (F.col("chunk") <= F.col("chunk2"))))
    met = settle(met.withColumn("cell", F.monotonically_increasing_id()))
    ends = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"len{s}").alias("len"), F.col(f"key{s}").alias("key"), F.col(f"chunk{s}").alias("chunk")) for i, s in enumerate(("", "2"))))
    single = (F.col("len") == F.col("len2")) & (F.col("key") == F.col("key2")) & (F.col("chunk") == F.col("chunk2"))
    alone = F.transform(F.slice(ends, 1, 1), lambda e: e.withField("side", F.lit(2)))
    members = met.select("cell", F.explode(F.when(single, alone).otherwise(ends)).alias("e")).select("cell", "e.*")
    dealt = words.join(sizes, ["len", "key"]).withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("chunks")).cast("int"))
    rows = dealt.join(members, ["len", "key", "chunk"]).select("cell", "side", "word", "n")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in sorted_groups(batches, 1):
            side, spelt, n = table.column(1).to_numpy(), table.column(2), table.column(3).to_numpy()
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                own = spelt.slice(lo, hi - lo).to_pylist()
                itself = side[lo] == 2  # a block with itself
                split = len(own) if itself else int((side[lo:hi] == 0).sum())
                if split in (0, len(own)) and not itself:
                    continue  # the hash left one of the two blocks empty
                x = _letters(own[:split], len(own[0]))
                i, j = near_pairs(x, x if itself else _letters(own[split:], len(own[-1])), groups, itself)
                if len(i):
                    j = j if itself else j + split
                    yield _best(np.array(own), n[lo:hi], np.concatenate([i, j]), np.concatenate([j, i]))

    found = rows.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def group_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 7, min_n: int = 2, ratio: int = 10, **more) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for each word of at least min_len letters and min_n occurrences."""
    words = settle_table(word_counts(df, id_col, text_col, min_len).filter(F.col("n") >= min_n))
    met = words.join(near_words(words, **more), "word", "left")
    strong = F.col("best_n") >= ratio * F.col("n")
    formed = settle_table(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n")))
    links = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):  # counts fit 63 bits and rise tenfold on each step: 18 steps at most, and 2^5 are followed
        links = settle(links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH RECURSIVE table_rows AS (SELECT unnest(range(256)) AS i),
steps AS (SELECT i, i::BIGINT AS c, 0 AS k FROM table_rows UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT d, run, n, list_transform(range(0, CAST(octet_length(encode(d || ':' || run)) AS BIGINT)), lambda i: ('0x' || substr(hex(encode(d || ':' || run)), 2 * i + 1, 2))::BIGINT) AS b FROM counted),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
replaced AS (SELECT a.word AS a, b.word AS b FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word),
dropped AS (SELECT DISTINCT h.word AS a, w.word AS b FROM holes h JOIN words w ON w.word = h.head || h.tail),
near AS (SELECT a, b FROM replaced UNION ALL SELECT a, b FROM dropped UNION ALL SELECT b, a FROM dropped),
best AS (SELECT a AS word, count(*) AS n_near, max(m.n) AS top FROM near JOIN words m ON m.word = near.b GROUP BY a),
chosen AS (SELECT best.word, n_near, top, min(m.word) AS best FROM best JOIN near ON near.a = best.word JOIN words m ON m.word = near.b AND m.n = top GROUP BY ALL),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN best END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM words w LEFT JOIN chosen c ON c.word = w.word),
chains AS (SELECT word, word AS at FROM formed UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.at AS root FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM formed f JOIN roots r ON r.word = f.word
"""
