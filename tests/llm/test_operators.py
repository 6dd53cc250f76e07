import hashlib
import math
import zlib
from collections import Counter
from fractions import Fraction
from itertools import combinations, islice

import numpy as np
import pytest
import xxhash
from conftest import SF

from pactlake.llm import chat_format, common, embedding_dedup, license_scan, lm_scoring, mixing, packing, quality_rules, registry, simhash_dedup, suffix_dedup, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, _shard string, _h string, _found string, _kept string, _drop string, _again string, _key0 string, count string, rows string"
LONG = "".join(chr(97 + int(c)) + " " * (i % 7 == 0) for i, c in enumerate(np.random.default_rng(8).integers(0, 26, 40_000)))
ROWS = [
    (1, None, None, None, 0), (2, "", "en", "a", 0), (3, "Under the MIT license.", "en", "a", 22), (4, "Under the MIT license.", "en", "a", 22), (4, "Under the MIT license.", "en", "a", 22),
    (None, "one two three four", "de", None, 18), (6, LONG, "de", "b", len(LONG)), (7, "x" * 450, "de", "b", 450), (8, "Ünïcode wörds ünd 日本語 " * 30, "fr", "b", 690),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *["clash"] * 10) for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_agrees_with_sql(agree, name):
    agree(registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (license_scan.scan_licenses(none), packing.pack(none), lm_scoring.score_texts(none), simhash_dedup.group_near(none), mixing.mix(none), quality_rules.judge_quality(none, labels), suffix_dedup.repeat_report(none), suffix_dedup.without_repeats(none), mixing.in_mixed_order(none)):
        assert out.count() == 0
    assert chat_format.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_license_scan_of_odd_rows(docs):
    rows = license_scan.scan_licenses(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r.doc_id: r for r in rows}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (0, 0, None, "")
    assert (got[3].base_labels, got[3].first_word, got[3].score) == ("mit", 0, 0.5)


def test_token_automaton_regions():
    a = license_scan.TokenAutomaton("a [[b {{2}}]] c")
    for text, want in (("a c", True), ("a b c", True), ("a b x y c", True), ("a b x y z c", False), ("a x c", False), ("z a c z", True)):
        split = text.split()
        assert a.found(b" " + text.encode() + b" ", split) is want
    with pytest.raises(ValueError):
        license_scan.TokenAutomaton("[[a]]")


def test_url_rules_by_trie_and_join(spark):
    urls = [None, "", "no-scheme", "http://www.example.com/en/x", "HTTP://Example.COM/en/", "http://example.com/english", "http://a.net/es/1?x", "http://net/fr/", "http://notexample.com", "http://x.com?/a", "http://x.com/#", "http://www.example.com/en"]
    df = spark.createDataFrame(list(enumerate(urls)) * 2, "page_id int, url string")
    by_trie = sorted(url_filter.filter_urls(df).collect(), key=str)
    assert by_trie == sorted(url_filter.filter_urls(df, broadcast_chars=0).select("page_id", "host", "path", "rule", "verdict").collect(), key=str)
    got = {r.page_id: (r.rule, r.verdict) for r in by_trie}
    assert got[3] == ("www.example.com/en/", "allow") and got[4] == ("example.com/en/", "block") and got[5] == ("com/", "allow") and got[8] == (None, "allow") and got[9] == (None, "allow")
    trie = url_filter.UrlTrie([("block", "b.c", "/x"), ("allow", "", "")])
    assert trie.find("a.b.c", "/xyz") == ("b.c/x", "block") and trie.find("b.c", "/y/x") == ("", "allow")


def test_chat_round_trip(spark):
    odd = ["", None, "\\", "### User:", "\\\\</turn>", "a\n</turn>\n\\", chat_format.PLANTED, "日本 ### Turn:</role>"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "tool", None) for t in odd)] + [(2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat_format.chat_digests(df).collect()}
    turns = [(r or "", t or "") for _, _, r, t in rows[:-3]]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
    assert got[2].loss_chars == 3 and got[2].n_turns == 3
    out = chat_format.format_chats(df).filter("conv_id = 1").first()
    assert len(out.formatted) == got[1].formatted_chars and set(out.mask) == {0, 1}


def test_chat_digests_of_a_hot_conversation(spark):
    """A conversation over many partitions and Arrow batches, and rows without a conversation, hash in order."""
    turn = lambda i: ("assistant" if i % 2 else "user", f"{i} </turn>")
    df = spark.range(0, 30_000, 1, 7).selectExpr("IF(id < 20000, 5L, IF(id < 25000, NULL, id)) AS conv_id", "id AS turn", "IF(id % 2 = 1, 'assistant', 'user') AS role", "concat(id, ' </turn>') AS text")
    got = {r.conv_id: r for r in chat_format.chat_digests(df).filter("conv_id = 5 OR conv_id IS NULL").collect()}
    for key, ids in ((5, range(20_000)), (None, range(20_000, 25_000))):
        turns = [turn(i) for i in ids]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[key].n_turns == len(turns) and got[key].loss_chars == len(loss)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_fingerprints_and_components(spark, table):
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]

    def fp(text):
        w = words(text)
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = {i: fp(t) for i, t in rows}
    near = {i: [j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3] for i in fps}
    root = {i: i for i in fps}
    for _ in fps:
        new = {i: min(root[j] for j in near[i]) for i in fps}
        if new == root:
            break
        root = new
    for posting in (2048, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.group_near(table, posting=posting).collect()}
        assert got == {i: (f"{fps[i]:016x}", root[i]) for i in fps}
    kept = {r.doc_id for r in simhash_dedup.keep_one(table).select("doc_id").collect()}
    assert kept == set(root.values())


def test_dense_fingerprints_lose_no_link(spark):
    rng = np.random.default_rng(1)
    values = {0}
    for _ in range(150):
        base = int(rng.choice(list(values)[-20:])) if len(values) > 1 else 0
        values.add(base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)))
    values |= {int(x) for x in rng.integers(0, 1 << 63, 50)}
    df = spark.createDataFrame([(v if v < 1 << 63 else v - (1 << 64),) for v in values], "fp long")
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= 3:
            parent[find(a)] = find(b)
    want = Counter(find(v) for v in values)
    for posting in (2048, 3):
        roots = common.components(simhash_dedup.link_edges(df, posting)).collect()
        sizes = Counter(r.root for r in roots)
        assert sorted(sizes.values()) == sorted(n for n in want.values() if n > 1)


def test_simhash_odd_rows(docs):
    got = simhash_dedup.group_near(docs).collect()
    assert len(got) == len(ROWS)
    of = {r.doc_id: r for r in got}
    assert of[1].fingerprint == "0" * 16 and of[2].component_id == 1 and of[4].component_id == 3
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cut = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cut[i : i + length] = True
        spans = int(np.diff(np.concatenate([[0], cut.astype(int)])).clip(0).sum())
        out.append((len(b), int(cut.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cut])).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"block": 3, "most_blocks": 100}, {"block": 2, "most_blocks": 1}])
def test_suffix_dedup_is_exact(spark, limits):
    rng = np.random.default_rng(5)
    word = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(200)]
    draw = lambda n: " ".join(rng.choice(word, n))
    shared, other = draw(60), draw(45)
    texts = [draw(30) + shared + draw(int(n)) for n in rng.integers(0, 60, 12)] + [other[:230] + draw(20), draw(9) + other[20:260], other[40:235], "ab" * 400, "z" * 199, "z" * 150, "é" * 130, "ü" + "é" * 130, None, "", shared + shared, texts_copy := draw(80), texts_copy, LONG]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.repeat_report(df, **limits).collect()}
    want = dict(enumerate(brute_repeats(texts)))
    assert {i: (got[i][:3], want[i][:3]) for i in want if got[i] != want[i]} == {}


def test_deep_shallow_order_sorts():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, int(n)).astype(np.uint8)) for n in rng.integers(0, 60, 300)] + [b"a" * 50] * 3 + [b"a" * 49]
    for shallow in (0, 8, 64):
        assert [texts[i] for i in suffix_dedup.deep_shallow_order(texts, shallow=shallow)] == sorted(texts)


def test_without_repeats_keeps_rows(docs):
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text is None and got[7].text == "" and got[7].n_chars == 0 and got[6].text == LONG


def test_packing_is_optimal_and_whole(spark, docs):
    rng = np.random.default_rng(3)
    lengths, counts = np.arange(8, 96, 8), rng.integers(1, 50, 11)
    cost = lambda cuts: sum(int(min(c for c in cuts if c >= v)) * int(n) for v, n in zip(lengths, counts, strict=True))
    best = min(cost([*c, 88]) for c in combinations(lengths[:-1], 3))
    assert cost(packing.optimal_boundaries(lengths, counts, 4)) == best
    rows = packing.pack(docs, max_len=1000, budget=2000).collect()
    per = Counter()
    for r in rows:
        per[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_len
    want = Counter()
    for i, t, *_ in ROWS:
        want[i] += len(words(t))
    assert per == want and len({(r.bucket, r.batch, r.place) for r in rows}) == len(rows)
    for bucket in {r.bucket for r in rows}:
        own = [r for r in rows if r.bucket == bucket]
        room = max(1, 2000 // own[0].bucket_len)
        assert sorted(r.batch * room + r.place for r in own) == list(range(len(own)))


def test_packing_pads_least_for_the_lengths_themselves(spark):
    """Of all boundaries, not only multiples of 8: by brute force over every choice of three lengths."""
    counts = {9: 40, 11: 3, 14: 25, 17: 8, 23: 30, 30: 2, 33: 11, 41: 5}
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(n for n, k in counts.items() for _ in range(k))], "doc_id long, text string")
    padded = lambda cuts: sum(min(c for c in cuts if c >= n) * k for n, k in counts.items())
    best = min(padded([*c, 41]) for c in combinations(list(counts)[:-1], 2))
    assert sum(r.bucket_len for r in packing.pack(df, buckets=3).collect()) == best
    assert all(r.bucket_len % 8 == 0 for r in packing.pack(df, buckets=3, step=8).collect())


def test_mixing_deviates_less_than_a_block(spark, docs):
    for weights in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05], [1, 1, 1, 1]):
        exact, had = [Fraction(w) for w in weights], Counter()
        for t, (lane, *_) in enumerate(islice(mixing.schedule([500] * len(weights), weights), 400), 1):
            had[lane] += 1
            assert all(abs(had[i] - t * w / sum(exact)) < 1 for i, w in enumerate(exact))
    df = spark.createDataFrame([(i, "ab"[i % 4 == 0], "x") for i in range(3000)], "doc_id long, source string, lane string")
    rows = mixing.mix(df, {"a": 1, "b": 1}, block_rows=10).collect()
    assert len({r.position for r in rows}) == 3000 and all(r.release <= r.slot < r.due for r in rows)
    assert Counter(r.source for r in rows if r.slot < 100) == {"a": 500, "b": 500}
    odd = mixing.mix(docs)
    assert odd.count() == len(ROWS)
    assert sorted(map(str, mixing.in_mixed_order(docs).collect())) == sorted(map(str, docs.collect()))


def most_lag(rows, weights, blocks):
    """The largest distance, in blocks, of any source from its exact weight after any slot of (lane, phase, slot)."""
    left, worst, phase = list(blocks), Fraction(0), None
    for lane, at, slot in sorted(rows, key=lambda r: r[2]):
        if at != phase:
            phase, start, had = at, slot, [0] * len(left)
            live = [i for i, n in enumerate(left) if n]
            total = sum(weights[i] for i in live)
        had[lane] += 1
        left[lane] -= 1
        worst = max(worst, *(abs(had[i] * total - weights[i] * (slot + 1 - start)) / total for i in live))
    assert not any(left)
    return worst


def test_mixing_keeps_to_the_weights_themselves(spark):
    """Against the weights as they are given or follow from the counts, over several thousand slots, for every source."""
    many = {f"s{i}": Fraction(3 if i == 299 else 1, 1 + i % 7) for i in range(300)}
    cases = [({"s0": 40_000} | {f"s{i}": 4_000 for i in range(1, 20)}, None), ({f"s{i}": 40 - i % 3 for i in range(300)}, many)]
    for sizes, weights in cases:
        df = spark.createDataFrame([(i, n) for i, n in enumerate(n for n, k in sizes.items() for _ in range(k))], "doc_id long, source string")
        rows = mixing.mix(df, weights, block_rows=20).collect()
        assert len({r.position for r in rows}) == len(rows) == sum(sizes.values())
        of = {r.source: r.lane for r in rows}
        assert len(set(of.values())) == len(sizes)
        goal = {of[n]: Fraction(weights[n] if weights else k**0.7) for n, k in sizes.items()}
        blocks = {of[n]: -(-k // 20) for n, k in sizes.items()}
        lanes = range(len(sizes))
        assert most_lag({(r.lane, r.phase, r.slot) for r in rows}, [goal[i] for i in lanes], [blocks[i] for i in lanes]) < 1


def test_mixing_with_a_joined_schedule_and_odd_weights(spark, docs):
    """The schedule joined by shuffle gives the same rows; a weight of zero comes last."""
    for weights in (None, {"a": 0, None: 2.5}):
        rows = [sorted(map(str, mixing.mix(docs, weights, block_rows=1, broadcast_blocks=n).collect())) for n in (0, 1000)]
        assert rows[0] == rows[1] and len(rows[0]) == len(ROWS)
    last = mixing.mix(docs, {"a": 0, "b": 1, None: 1}, block_rows=1).orderBy("position").collect()
    assert [r.source for r in last[-4:]] == ["a"] * 4
    with pytest.raises(ValueError):
        list(mixing.schedule([1], [-1]))


def test_language_model(spark, table, docs, monkeypatch):
    """Counts and base score against brute force; the score from the trained vectors, with all classes by hand."""
    made, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda pairs, classes: made.append((train(pairs, classes), {(r.a, r.b): r.n for r in pairs.collect()})) or made[-1][0])
    rows = {r.doc_id: r for r in lm_scoring.score_texts(table).collect()}
    texts = {r.doc_id: words(r.text) for r in table.select("doc_id", "text").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, ws in texts.items() if not held[i] for w in [*ws, None])
    n, v = sum(c.values()), len(c)
    [(model, pairs)] = made
    classes = math.isqrt(n)
    shared, exact = classes // 4, classes - classes // 4
    top = {w: i for i, w in enumerate(sorted((w for w in c if w), key=lambda w: (-c[w], w))[: exact - 1], 1)} | {None: 0}
    cls = lambda w: top[w] if w in top else exact + zlib.crc32(w) % shared
    tokens, kinds = Counter(), Counter()
    for w in c:
        tokens[cls(w)] += c[w]
        kinds[cls(w)] += 1
    logits = model.context.astype(float) @ model.target.T + model.bias
    log_p = (logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))) / math.log(10)
    assert len(model.bias) == classes
    assert pairs == Counter(p for i, ws in texts.items() if not held[i] for p in zip(map(cls, [None, *ws]), map(cls, [*ws, None]), strict=True))
    for i, ws in texts.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[i], len(ws) + 1, n, sum(c[w] > 0 for w in [*ws, None]))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), rel_tol=1e-9)
        inside = sum(math.log10((c[w] + 0.5) / (tokens[cls(w)] + 0.5 * (kinds[cls(w)] + 1))) for w in ws if w not in top)
        assert math.isclose(r.score, inside + sum(log_p[cls(a), cls(b)] for a, b in zip([None, *ws], [*ws, None], strict=True)), rel_tol=1e-4, abs_tol=1e-3)
    out = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    few = {r.doc_id: r for r in lm_scoring.score_texts(table, head=500, offer=300, most_classes=64).collect()}
    assert len(made[1][0].bias) == 64 and all(math.isclose(few[i].base_score, rows[i].base_score, rel_tol=1e-9) for i in rows)
    odd = lm_scoring.score_texts(docs, head=50).collect()
    assert len(odd) == len(ROWS) and all(math.isfinite(r.score) for r in odd)


def test_language_model_grows_and_learns_neighbours(spark, monkeypatch):
    """Four times the text has twice the classes; in held-out texts of alternating words the model knows what follows."""
    made, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda pairs, classes: made.append(classes) or train(pairs, classes))
    for size in (20, 80):
        rng = np.random.default_rng(9)
        df = spark.createDataFrame([(i, " ".join(f"{'ab'[j % 2]}{k}" for j, k in enumerate(rng.integers(0, 20, 30)))) for i in range(size)], "doc_id long, text string")
        held = [r for r in lm_scoring.score_texts(df).collect() if r.held_out]
        gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.1  # knowing which half of the words comes is worth log10(2), or 0.3
    assert 1.7 < made[1] / made[0] < 2.3


def test_log_bilinear_model(spark):
    """Rows are normalised, blocks don't matter, and the vectors lie where the objective has no slope left."""
    n = np.random.default_rng(4).integers(0, 50, (30, 30))
    n[:, 7] = n[7] = 0
    pairs = spark.createDataFrame([(i, j, int(n[i, j])) for i in range(30) for j in range(30) if n[i, j]], "a long, b long, n long")
    some, other = (lm_scoring.train(pairs, 30, dim=8, cells=cells) for cells in (1 << 21, 60))
    at = np.repeat(np.arange(30), 30), np.tile(np.arange(30), 30)
    p = np.array([[some.log10(np.array([a]), np.array([b])) for b in range(30)] for a in range(30)])
    assert np.allclose((10.0**p).sum(axis=1), 1, atol=1e-4)
    assert math.isclose(some.log10(*at), other.log10(*at), rel_tol=1e-3) and math.isclose(p.sum(), some.log10(*at, batch=7), rel_tol=1e-5)
    rng = np.random.default_rng(5)
    x, y, real, noise = rng.normal(size=(3, 4)), rng.normal(size=(50, 4)), rng.integers(0, 9, (3, 50)), rng.random((3, 50)) * 9
    best = lm_scoring.refine(x, y, real, noise, np.float64(-1), 3.0, 30)
    s = 1 / (1 + np.exp(-(best @ y.T - 1)))
    assert np.abs((real - (real + noise) * s) @ y - 3.0 * best).max() < 1e-6


def test_embedding_odd_vectors(spark):
    unit = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, unit, 1), (2, unit, 1), (2, unit, 1), (3, [2.0, 0.01, 0.0, 0.0], 1), (4, unit, 2), (5, unit, None), (6, None, 1), (7, [0.0] * 4, 1), (8, [float("nan"), 1.0, 0.0, 0.0], 1), (9, [None, 1.0, 0.0, 0.0], 1), (10, [1.0], 1), (11, [], 1), (12, [float("inf"), 0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df).collect())
    assert got[:4] == [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False)]
    assert all(r[1] == 0 and r[3] for r in got[4:])


def test_embedding_recall_and_blocks(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(0, 40, 600)] + rng.normal(size=(600, 32)) * 0.22).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= 0.93) & ~np.eye(600, dtype=bool)
    for rows in (1024, 16):
        got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df, list_rows=rows).collect()}
        assert all(got[i] <= linked[i].sum() for i in range(600))
        assert sum(got.values()) >= 0.9 * linked.sum()


def test_quality_odd_rows_and_bounds(spark, docs):
    labels = spark.createDataFrame([(3, None, 0), (6, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge_quality(docs, labels).collect()
    assert len(got) == len(ROWS) and {r.doc_id for r in got if r.kept} == {6}
    assert quality_rules.keep_good(docs, labels).columns == docs.columns
    from pyspark.sql import functions as F

    p = 0.005
    df = spark.createDataFrame([(0, 900), (2, 900), (4, 1500), (9, 1000)], "k long, n long").withColumn("tail", quality_rules.binomial_tail(F.col("k"), F.col("n"), p))
    for r in df.collect():
        exact = sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1))
        assert r.tail == (1.0 if r.k > r.n * p else pytest.approx(exact, rel=1e-9))


def test_quality_levels_are_proven_in_order(spark):
    """Good texts break the third level too often, two strata have labels enough, the third has too few to be tested."""
    from pyspark.sql import functions as F

    line = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    noisy = lambda i, n: line(i) + " " + "#" * n  # noqa: E731  about 4 characters a word
    rows, labels = [], []
    for lang, good, share in (("a", 400, 0), ("b", 400, 60), ("c", 100, 0)):
        for i in range(good + 20):
            k = len(rows)
            n = 100 if i < share else 0 if i < good else 400
            rows.append((k, noisy(k, n), lang))
            labels.append((k, int(i < good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = docs.select("doc_id", "lang", quality_rules.quality_counts(F.col("text")).alias("c")).select("doc_id", "lang", "c.w.*", "c.l.*", "c.word_chars", "c.n_symbols")
    per = {r.doc_id: r for r in counts.collect()}

    def breaks(r, level):
        return any(100 * r[top] > cut * r[bottom] > 0 for (top, bottom), cut in zip(quality_rules.RULES.values(), quality_rules.LEVELS[level], strict=True))

    want = {}
    strata = {lang: [per[k] for k, _, of in rows if of == lang and labels[k][1]] for lang in "abc"}
    tested = [lang for lang, own in strata.items() if 0.98 ** len(own) <= 0.05]
    assert tested == ["a", "b"]
    for lang, own in strata.items():
        want[lang] = 0
        for level in range(len(quality_rules.LEVELS)):
            k, n = sum(breaks(r, level) for r in own), len(own)
            if lang not in tested or sum(math.comb(n, i) * 0.02**i * 0.98 ** (n - i) for i in range(k + 1)) > 0.05 / len(tested):
                break
            want[lang] = level + 1
    got = {r["_stratum"]: r["_level"] for r in quality_rules.certified_levels(counts, marks, "doc_id", "lang").collect()}
    assert got == want and want["a"] == len(quality_rules.LEVELS) and 0 < want["b"] < want["a"] and want["c"] == 0
    kept = {r.doc_id: r.kept for r in quality_rules.judge_quality(docs, marks).collect()}
    assert kept == {k: not (want[of] and breaks(per[k], want[of] - 1)) for k, _, of in rows}


def test_embedding_keys_grow_and_lose_little(spark):
    """Keys and tables of a far larger table, on few vectors, codes compared first; several lengths, most not fitted."""
    assert embedding_dedup.key_sizes(30_000, 0.93)[0] == 12 < embedding_dedup.key_sizes(10**7, 0.93)[0]
    rng = np.random.default_rng(9)
    base = rng.normal(size=(80, 64))
    x = (base[rng.integers(0, 80, 500)] + rng.normal(size=(500, 64)) * 0.24).astype(np.float32)
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(1000 + 2 * d + j, [1.0, *[0.0] * d], 1) for d in range(5) for j in range(2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    linked = (y @ y.T >= 0.93) & ~np.eye(500, dtype=bool)
    bits, tables = embedding_dedup.key_sizes(10**6, 0.93)
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df, key_bits=bits, tables=tables, fitted_lengths=1).collect()}
    assert all(got[i] <= linked[i].sum() for i in range(500)) and sum(got[i] for i in range(500)) >= 0.9 * linked.sum() > 0
    assert all(got[i] == 1 for i in range(1000, 1010))


def test_license_places_in_a_long_text(spark):
    df = spark.createDataFrame([(1, "cc by nc " * 30_000)], "doc_id long, text string")
    r = license_scan.scan_licenses(df).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (90_000, 30_000, 0, 89_997)


def test_numbers_are_consecutive(spark):
    df = spark.createDataFrame([(i % 3 or None, i) for i in range(700)], "g long, i long")
    rows = common.numbered(df, ["g"], ["i"], "k", shard_rows=50, stretch=3).collect()
    for g in (None, 1, 2):
        own = [r.k for r in rows if r.g == g]
        assert sorted(own) == list(range(len(own)))
