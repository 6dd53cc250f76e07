"""URL filters: a trie over reversed host labels and path segments, longest match between allow and block entries.

Rules are (action, host, path). A rule fits its host and all subdomains if the url's path starts with the rule's
path; of the rules that fit, the one with the most characters in host and path wins, then the one with the longer
host, then block before allow. Null urls and urls without "://" have empty host and path; they meet only rules with
an empty host. Urls that no rule fits get the default verdict. Repeated rows stay repeated; an empty table gives an
empty result; extra columns of the input are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed rules of op8.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_LOWER = {c: c + 32 for c in range(65, 91)}
_STEP = re.compile(r"[^/]*/|[^/]+")


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    path = re.match(r"[^?#]*", rest[end:]).group()
    return rest[:end].translate(_LOWER), path


class _Node:
    """A host label's node: children by label, and the paths that end at this host as a trie of their own."""

    __slots__ = ("down", "paths")

    def __init__(self) -> None:
        self.down: dict[str, _Node] = {}
        self.paths = None


class _Paths:
    """A path segment's node: whole segments go down; parts hold last segments that may go on in the url."""

    __slots__ = ("down", "here", "parts")

    def __init__(self) -> None:
        self.down: dict[str, _Paths] = {}
        self.here = None
        self.parts: dict[str, tuple] = {}


class UrlTrie:
    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        self.root = _Node()
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.down.setdefault(label, _Node())
            at = node.paths = node.paths or _Paths()
            entry = (len(host) + len(path), len(host), action == "block", host + path, action)
            for step in _STEP.findall(path):
                if not step.endswith("/"):
                    at.parts[step] = max(entry, at.parts.get(step, entry))
                    break
                at = at.down.setdefault(step, _Paths())
            else:
                at.here = max(entry, at.here or entry)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, action) of the longest match."""
        best, node, steps = None, self.root, _STEP.findall(path)
        labels = host.split(".")[::-1] if host else []
        for label in [None, *labels]:
            if label is not None:
                node = node.down.get(label)
                if node is None:
                    break
            at = node.paths
            for step in [*steps, None] if at else ():
                found = [at.here] if at.here else []
                if step is not None:
                    found += [e for part, e in at.parts.items() if step.startswith(part)]
                best = max([*found, best] if best else found, default=best)
                at = at.down.get(step)
                if at is None:
                    break
        return best and (best[3], best[4])


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_chars: int = 16_000_000) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each input row.

    The trie is sent to the executors only while the rules hold no more than broadcast_chars characters; a larger
    rule set is joined by host suffix instead (see filter_urls_by_join), with the same result.
    """
    spark = df.sparkSession
    if sum(len(h) + len(p) for _, h, p in rules) > broadcast_chars:
        table = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
        return filter_urls_by_join(df, table, id_col, url_col, default)
    trie = spark.sparkContext.broadcast([tuple(r) for r in rules])
    kind = df.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = UrlTrie(trie.value)
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, action = tree.find(host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(rule)
                verdicts.append(action)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=["id", "host", "path", "rule", "verdict"])

    return df.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def url_parts(url: str = "url") -> tuple[F.Column, F.Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substr(F.col(url), at + 3))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def filter_urls_by_join(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same result for rule tables of any size: distinct (host, path) pairs, exploded to host suffixes, joined."""
    host, path = url_parts(url_col)
    urls = df.select(id_col, host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    keyed = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    r = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"))
    fits = keyed.join(r, F.col("suffix") == F.col("rule_host")).filter(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), (F.col("action") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("rule"), "action")
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_FITS = " UNION ALL ".join(f"SELECT '{a}' AS action, '{h}' AS rh, '{p}' AS rp" for a, h, p in RULES)
OP8_SQL = f"""
WITH rules AS ({_FITS}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (SELECT host, path, max(row(length(rh) + length(rp), length(rh), action = 'block', rh || rp, action)) AS b
    FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, b[4] AS rule, coalesce(b[5], 'allow') AS verdict
FROM parts p LEFT JOIN best USING (host, path)
"""
