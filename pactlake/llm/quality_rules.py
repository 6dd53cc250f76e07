"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each text gets counts; fixed base rules reject some texts. Beside them stand rules of the form "rate above a cutoff".
Their cutoffs form a fixed sequence of levels, each at least as tight in every rule as the one before. For each stratum
the levels are tested in that order on labelled holdout rows: a level may be used only if the exact binomial upper
bound of the share of good texts that it rejects, all its rules together, stays within alpha, at confidence
1 - delta / (number of strata tested). Testing stops at the first level that isn't proven, so the number of levels
costs no correction, and over all strata a false proof has probability delta at most. Strata with so few good labels
that not even a level without rejections could be proven are not tested, which their number alone decides; they use
no level and lose nothing beyond the base rules.

A null text has no words. Rates over nothing are 0. A null stratum is a stratum of its own. Labels with null quality
are left out; of repeated labels of one document the highest counts. Repeated rows stay repeated; an empty table
gives an empty result; extra columns of the input are left out (keep_good keeps them, whatever their names).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, free_name, settle

#: rule -> (numerator, denominator)
RULES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
#: Cutoffs of the rules, in that order and in hundredths, from the loosest level to the tightest.
LEVELS = ((30, 70, 40, 1600), (20, 50, 40, 1200), (15, 40, 30, 1000), (10, 30, 20, 1000), (5, 30, 20, 1000), (5, 20, 15, 900), (2, 10, 10, 800))
ALPHA, DELTA = 0.02, 0.05


def _let(value: Column, body) -> Column:
    """body(x) with x evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words covered by three-word windows that occur at least twice. Windows are sorted by their hashes with their
    places; those of equal hash are compared word by word with their neighbours."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def positions(s: Column) -> Column:
        word = lambda i, d: F.get(words, F.get(s, i)["i"] + d)
        equal = lambda i, j: F.get(s, i)["w"].eqNullSafe(F.get(s, j)["w"]) & word(i, 0).eqNullSafe(word(j, 0)) & word(i, 1).eqNullSafe(word(j, 1)) & word(i, 2).eqNullSafe(word(j, 2))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: equal(i, i - 1) | equal(i, i + 1))
        return F.array_sort(F.transform(at, lambda i: F.get(s, i)["i"]))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def count(t: Column) -> Column:
        pairs = F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0).cast("long")).otherwise(covered(_let(pairs, positions)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(hashes, count))


def quality_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.translate(text, ASCII_SPACE[1:], " " * 5), " "), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    chars = lambda drop: F.length(F.translate(text, drop, "")).cast("long")
    return F.struct(by_word.alias("w"), chars(ASCII_SPACE).alias("word_chars"), (F.length(text) - chars("#*$%&|<>")).alias("n_symbols"), by_line.alias("l"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _breaks(level: int) -> Column:
    """Whether a text breaks any rule at a level's cutoffs."""
    tests = [(100 * F.col(top) > cut * F.col(bottom)) & (F.col(bottom) > 0) for (top, bottom), cut in zip(RULES.values(), LEVELS[level], strict=True)]
    return reduce(lambda a, b: a | b, tests)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed exactly; 1 where k is above the mean (it is over a half there)."""
    from math import log

    odds = log(p / (1 - p))
    start = F.struct((n * log(1 - p)).alias("term"), F.exp(n * log(1 - p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    some = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1))), start, step, lambda acc: acc["sum"])
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(n * log(1 - p))).otherwise(some)


def certified_levels(counts: DataFrame, labels: DataFrame, id_col: str, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(_stratum, _level): how many levels are proven; the last of them is used, 0 stands for none."""
    good = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_labelled")).agg(F.max("quality").alias("_quality")).filter("_quality = 1")
    held = counts.join(good, counts[id_col] == F.col("_labelled"))
    hits = [F.sum(_breaks(i).cast("long")).alias(f"k{i}") for i in range(len(LEVELS))]
    per = settle(held.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_n"), *hits))
    enough = F.pow(F.lit(1 - alpha), F.col("_n")) <= delta
    tested = max(1, per.filter(enough).count())
    # A tighter level rejects what a looser one does and more, so the proven levels are the first ones.
    proven = [(binomial_tail(F.col(f"k{i}"), F.col("_n"), alpha) <= delta / tested).cast("int") for i in range(len(LEVELS))]
    return per.select("_stratum", F.when(enough, reduce(lambda a, b: a + b, proven)).otherwise(0).alias("_level"))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, broadcast_strata: int = 10_000) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each input row."""
    c = docs.select(F.col(id_col), F.col(stratum).alias("_of"), quality_counts(F.col(text_col)).alias("_c"))
    counts = settle(c.select(id_col, "_of", "_c.w.n_words", "_c.word_chars", "_c.n_symbols", "_c.l.n_lines", "_c.l.n_dup_lines", "_c.w.n_repeat_words"))
    levels = settle(certified_levels(counts, labels, id_col, "_of", alpha, delta))
    small = F.broadcast(levels) if levels.count() <= broadcast_strata else levels
    out = counts.join(small, F.col("_of").eqNullSafe(F.col("_stratum")), "left")
    broken = reduce(lambda a, b: a | b, ((F.coalesce("_level", F.lit(0)) == i + 1) & _breaks(i) for i in range(len(LEVELS))))
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | broken))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Ids that occur with several texts are kept if
    any of these is."""
    name = free_name(docs)
    kept = judge_quality(docs, labels, id_col, **more).filter("kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(settle(kept), docs[id_col].eqNullSafe(F.col(name)), "left_semi")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql() -> str:
    breaks = lambda i: "(" + " OR ".join(f"100 * {top} > {cut} * {bottom} AND {bottom} > 0" for (top, bottom), cut in zip(RULES.values(), LEVELS[i], strict=True)) + ")"
    tail = lambda k: f"(CASE WHEN {k} > n * {ALPHA!r} THEN 1.0 ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA!r}) + (n - i) * ln(1 - {ALPHA!r})))) END)"
    hits = ", ".join(f"count(*) FILTER (WHERE {breaks(i)}) AS k{i}" for i in range(len(LEVELS)))
    proven = " + ".join(f"CASE WHEN {tail(f'k{i}')} <= {DELTA!r} / m THEN 1 ELSE 0 END" for i in range(len(LEVELS)))
    broken = " OR ".join(f"(coalesce(level, 0) = {i + 1} AND {breaks(i)})" for i in range(len(LEVELS)))
    return f"""
WITH raw AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM raw),
rep AS (SELECT doc_id, count(*) AS n_rep FROM (
    SELECT DISTINCT doc_id, pos + d AS word FROM (
        SELECT doc_id, pos FROM (SELECT doc_id, unnest(tri) AS x, generate_subscripts(tri, 1) AS pos FROM win) QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1), range(3) r(d)) GROUP BY doc_id),
counts AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_rep, 0)::BIGINT AS n_repeat_words FROM win LEFT JOIN rep USING (doc_id)),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1),
per AS (SELECT lang, count(*) AS n, {hits} FROM counts JOIN good USING (doc_id) GROUP BY lang),
sized AS (SELECT *, (SELECT greatest(count(*), 1) FROM per WHERE pow(1 - {ALPHA!r}, n) <= {DELTA!r}) AS m FROM per),
cutoffs AS (SELECT lang, CASE WHEN pow(1 - {ALPHA!r}, n) <= {DELTA!r} THEN {proven} ELSE 0 END AS level FROM sized),
judged AS (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {broken} AS broken
    FROM counts c LEFT JOIN cutoffs t ON c.lang IS NOT DISTINCT FROM t.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR broken) AS kept FROM judged
"""


OP9_SQL = _sql()
