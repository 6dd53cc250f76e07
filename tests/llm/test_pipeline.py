from itertools import combinations

import corpus_pipeline
from conftest import SF
from pyspark.sql import functions as F
from test_operators import brute_repeats, words

from pactlake.llm import common, mixing, quality_rules, simhash_dedup


def bits(text):
    return simhash_dedup.fingerprint((text or "").encode())


def test_stages_against_brute_force(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        if i == 4:
            order = {r.doc_id: r.at for r in docs.select("doc_id", common.stored_order(docs).alias("at")).collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        seen.append(name)
        if i < 4:
            assert docs.columns == cols
        after = {r.doc_id: r for r in rows}
        if i == 0:
            found = duck.execute(quality_rules.OP9_SQL)
            names = [d[0] for d in found.description]
            kept = {r[names.index("doc_id")] for r in found.fetchall() if r[names.index("kept")]}
            assert set(after) == kept and 0 < len(rows) < len(before)
        if i == 1:
            root = {k: k for k in before}
            links = [(a, b) for a, b in combinations(sorted(before), 2) if (bits(before[a].text) ^ bits(before[b].text)).bit_count() <= 3]
            for _ in links:
                for a, b in links:
                    root[a] = root[b] = min(root[a], root[b])
            assert set(after) == {k for k, r in root.items() if k == r} and len(after) == len(rows) < len(before)
        if i == 2:
            want = brute_repeats([before[k].text for k in before])
            for k, w in zip(before, want, strict=True):
                assert abs(len((after[k].text or "").encode()) - (w[0] - w[1])) <= 3 * 2 * w[2]
                assert after[k].n_chars == len(after[k].text)
        if i == 3:
            assert sorted(map(str, rows)) == sorted(map(str, before.values()))
        if i == 4:
            for top in {r.bucket_len for r in rows}:
                room, own = max(1, 65_536 // top), sorted((r.batch, r.place, r.doc_id) for r in rows if r.bucket_len == top)
                assert [(b, p) for b, p, _ in own] == [divmod(j, room) for j in range(len(own))]
                placed = [order[k] for _, _, k in own]
                assert placed == sorted(placed)
            assert {k: len(words(before[k].text)) for k in before} == {k: sum(r.n_tokens for r in rows if r.doc_id == k) for k in before}
    assert len(seen) == 5


def test_mixing_decides_where_packing_puts_pieces(spark, monkeypatch):
    """In run()'s rows the pieces of a bucket stand in the mixed order, so other target weights give other batches."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = sorted(r[0] for r in docs.select("source").filter("source IS NOT NULL").distinct().collect())
    found = []
    for weights in ({n: 1 + 50 * (n == names[0]) for n in names}, {n: 1 + 50 * (n == names[-1]) for n in names}):
        mixed = lambda spark, docs, sf_dir, w=weights: mixing.in_mixed_order(docs, weights=w)
        monkeypatch.setattr(corpus_pipeline, "STAGES", [("mixing", mixed), corpus_pipeline.STAGES[-1]])
        rows = corpus_pipeline.run(spark, SF).collect()
        at = {r.doc_id: r.position for r in mixing.mix(docs, weights).collect()}
        for bucket in {r.bucket for r in rows}:
            own = [(at[r.doc_id], r.piece) for r in sorted(rows, key=lambda r: (r.batch, r.place)) if r.bucket == bucket]
            assert own == sorted(own)
        found.append({(r.doc_id, r.piece): (r.bucket, r.batch, r.place) for r in rows})
    assert found[0].keys() == found[1].keys() and found[0] != found[1]


def test_numbers_along_the_stored_order(spark, tmp_path):
    """Files are read in any order; the order of writing is kept over many files, and those of one partition."""
    docs = spark.range(5000).select("id", (-F.col("id")).alias("key")).repartition(7).sort("key")
    docs.write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    read = read.select("id", (F.col("id") % 2).alias("g"), common.stored_order(read).alias("at"))
    rows = common.numbered(read, ["g"], ["id"], "k", shard_rows=64, along="at").collect()
    assert {r.id: r.k for r in rows} == {i: (4999 - i) // 2 for i in range(5000)}


def test_odd_documents_and_empty_tables(spark, tmp_path):
    """Nulls, repeated rows, a very long text, equal texts, columns with clashing names; and no rows at all."""
    long = " ".join(f"w{i}" for i in range(40_000))
    plain = lambda seed: " ".join(f"{seed}x{i * i % 97}y{i}" for i in range(80))
    rows = [(1, None, "en", "a"), (2, "", None, "a"), (3, plain("q"), "en", None), (4, plain("q"), "de", "b"), (4, plain("q"), "de", "b"), (5, long, "en", "a"), (None, plain("z"), "en", "a"), (6, "few words", "en", "a"), (7, plain("v"), None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "m", "k", "s") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _metadata string, _key0 string, _shard string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    tokens = {k: sum(r.n_tokens for r in got if r.doc_id == k) for k in {r.doc_id for r in got}}
    assert tokens == {3: 80, 5: 40_000, None: 80, 7: 80}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
