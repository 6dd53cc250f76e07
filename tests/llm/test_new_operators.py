"""Spelling variants, hard negatives and byte-pair encoding against brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pactlake.llm import bpe_codec, hard_negatives, lm_scoring, spelling_variants

ODD = [None, "", "   ", "Straße ÀÉÎ naïveté naïvete naivete", "x" * 50_000, "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|>", "日本語 ﬁ İstanbul ΑΣ ΑΣΑ\u0085 x", "été été's 'll don't 12,5"]


def lower(text):
    return (text or "").translate(spelling_variants._LOWER)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, min_len=7, min_n=2, ratio=10):
    """The rows of group_variants by comparing all words with all."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", lower(text)):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            counts[word] += len(word) >= min_len
    words = {w: n for w, n in counts.items() if n >= min_n}
    by = {w: [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)] for w in words}
    form = {w: min(by[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(by[w]), form[w] and words[form[w]]) for w, n in words.items()}


def words_of(seed, n=400):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abeiou", k=rng.randint(7, 9))) for _ in range(12)] + ["ÀÿÉabcdefg", "ÿÿÿÿÿÿÿ"]
    texts = []
    for i in range(n):
        picked = [rng.choice(stems[: 2 + i % 14]) for _ in range(rng.randint(1, 12))]
        texts.append((i % 50, " ".join(w if rng.random() < 0.8 else w[: (k := rng.randrange(len(w)))] + rng.choice(["", "z", "y" + w[k]]) + w[k + 1 :] for w in picked)))
    return texts + [(None, "abcdefgh abcdefgh"), (3, None), (4, ""), (5, "ABCDEFGH ÀÉÎÕÜßæ àéîõüßæ " * 3)]


@pytest.mark.parametrize("more", [{}, {"block": 3, "groups": 5}, {"block": 1, "groups": 1}])
def test_variants_of_planted_words(spark, more):
    rows = words_of(1)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, word string, n string").repartition(3)
    got = [tuple(r) for r in spelling_variants.group_variants(df, **more).collect()]
    assert len(got) == len(set(got)) and set(got) == variants(rows)


def test_pairs_of_one_block_are_all_found():
    rng = np.random.default_rng(2)
    for a, b, groups in ((7, 7, 13), (7, 8, 13), (7, 8, 4)):
        x, y = (rng.integers(97, 100, (300, k)).astype(np.uint8) for k in (a, b))
        x, y = np.unique(x, axis=0), np.unique(y, axis=0)
        i, j = spelling_variants.near_pairs(x, y, groups, False, tile=16)
        want = {(p, q) for p in range(len(x)) for q in range(len(y)) if near(bytes(x[p]), bytes(y[q]))}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want
        i, j = spelling_variants.near_pairs(x, x, groups, True, tile=16)
        assert len(i) == sum(near(bytes(x[p]), bytes(x[q])) for p in range(len(x)) for q in range(p))


def test_strassen_equals_the_plain_product():
    rng = np.random.default_rng(3)
    for m, k, n in ((1, 1, 1), (5, 64, 7), (65, 33, 70), (130, 64, 131), (0, 4, 3), (3, 0, 2)):
        a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-4, 4, (k, n))
        assert (hard_negatives.strassen(a, b, leaf=4) == a @ b).all()


VECTORS = "vec_id long, embedding array<float>, label int, score string, slot string"


def mined(rows, is_anchor, k=5, percent=80):
    """The rows of mine_negatives by plain integers."""
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = Counter()
    for at, (i, v, lab) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, lab2) for q, (j, w, lab2) in enumerate(good) if q != at)
        for s, j, _ in [x for x in scored if x[2] == lab][:k]:
            hits = [x for x in scored if x[2] != lab and percent * -s <= -100 * x[0] <= -100 * s][:k]
            out.update((i, j, r, x[1], -s, -x[0]) for r, x in enumerate(hits, 1))
    return out


@pytest.mark.parametrize("more", [{}, {"cell": (3, 16), "tile": (2, 5)}])
def test_negatives_by_brute_force(spark, more):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0.3, 0.5, 6).tolist(), int(rng.integers(0, 3))) for i in range(120)]
    rows += [(120, None, 1), (121, [None] * 6, 1), (122, [float("nan")] * 6, 1), (123, [float("inf")] * 6, 1), (124, [1.0] * 6, None), (None, [1.0] * 6, 1), (125, [0.5, 0.25], 1), (130, [], 2), (140, [0.0] * 6, 0), (150, [-1.0] * 6, 0)]
    rows += [(160, [0.5] * 6, lab) for lab in (0, 0, 0, 1, 1)] + [(170 + i, [0.5] * 6, i % 2) for i in range(14)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], VECTORS).repartition(3)
    got = Counter(tuple(r) for r in hard_negatives.mine_negatives(df, F.col("id") % 10 == 0, **more).collect())
    assert got == mined(rows, lambda i: i % 10 == 0) and sum(got.values()) > 100
    assert hard_negatives.mine_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert hard_negatives.mine_negatives(df, F.lit(False)).count() == 0


def test_vectors_of_large_numbers(spark):
    rows = [(0, [1e30, -1e30], 1), (1, [2.0**20, 1.0], 1), (2, [2.0**20, 0.5], 1), (3, [2.0**19, 1.0], 2)]
    made = {r.id: np.frombuffer(r.v, "<i2" if r.v[0] == 2 else "<i8", offset=1).tolist() for r in hard_negatives.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label").collect()}
    assert made == {0: [2**63 - 1, -(2**63)], 1: [2**28, 256], 2: [2**28, 128], 3: [2**27, 256]}


def test_pair_tree_gives_the_leftmost_lowest():
    rng = random.Random(5)
    for n in (0, 1, 2, 7, 33):
        ranks = [rng.choice([bpe_codec.NONE, *range(4)]) for _ in range(n)]
        tree = bpe_codec.PairTree(ranks)
        for _ in range(60):
            low = min(ranks, default=bpe_codec.NONE)
            assert tree.first() == (None if low == bpe_codec.NONE else ranks.index(low))
            if n:
                i = rng.randrange(n)
                ranks[i] = rng.choice([bpe_codec.NONE, *range(4)])
                tree.set(i, ranks[i])


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe_codec.word_pieces_path())


def test_pieces_of_odd_texts(tokenizer):
    codec, rng = bpe_codec.codec(bpe_codec.word_pieces_path()), random.Random(6)
    letters = [*"abcdeilmnorstuv    ''12.,<|>", *"éÉ́ΣαİßÀ \u0085\x00日ﬁ͸Ᲊ", "<|endoftext|>", "<|startoftext|>"]
    for text in [*ODD[1:], *("".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)), *(f"a{chr(c)}b1" for c in range(0, 0x3000))]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = [i for ids, _, _ in codec.encode(text, kept=50) for i in ids]
        assert got == want and codec.decode(got) == tokenizer.decode(want, skip_special_tokens=False), text


def test_digests_of_a_table(spark, tokenizer):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = table.unionByName(spark.createDataFrame([(-i, t) for i, t in enumerate([*ODD, "a a", "a a"], 1)], "doc_id long, text string")).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in bpe_codec.token_digests(df, bpe_codec.word_pieces_path()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = df.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    both = bpe_codec.decode_ids(bpe_codec.encode_texts(df.filter("doc_id < 0").drop("ids"), bpe_codec.word_pieces_path()), bpe_codec.word_pieces_path()).collect()
    for r in both:
        assert list(r.ids) == tokenizer.encode(r.text or "", add_special_tokens=False).ids and r.decoded == tokenizer.decode(list(r.ids), skip_special_tokens=False)
    assert bpe_codec.token_digests(df.limit(0), bpe_codec.word_pieces_path()).count() == 0


def test_no_words_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants.group_variants(none).count() == 0
    assert spelling_variants.group_variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="not a byte-level"):
        bpe_codec.BpeCodec(bpe_codec.word_pieces_path().replace("word_bpe_49k", "byte_bpe_50k"))


def test_language_model_whatever_the_partitions(spark):
    """Classes follow from exact counts: one partition or six, counts handed on early or at the end."""
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some, other = ({r.doc_id: r for r in lm_scoring.score_texts(table.repartition(n), offer=offer).collect()} for n, offer in ((1, 1 << 19), (6, 60)))
    assert some.keys() == other.keys()
    for i, r in some.items():
        assert (r.n_known, r.train_tokens) == (other[i].n_known, other[i].train_tokens)
        assert math.isclose(r.base_score, other[i].base_score, rel_tol=1e-9) and math.isclose(r.score, other[i].score, rel_tol=1e-5)
