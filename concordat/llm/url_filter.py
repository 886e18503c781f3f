"""URL filter lists as a trie over reversed host labels and path segments.

Rules are (action, host, path). A rule fits its host and all subdomains if the URL's path starts with
the rule's path. Of several fitting rules the one with the most host labels wins, then the longest
path; between an allow and a block entry for the same host and path, block wins. Rules are brought to
one form first: A-Z in hosts lower-cased, one entry for a host and path, which is what ``rule`` shows.
The trie is built once and broadcast if there are at most ``MAX_BROADCAST_RULES`` entries of
``MAX_BROADCAST_CHARS`` characters together; a longer list is instead joined by hash on the (host
suffix, path prefix) keys that a URL can match, at path lengths that occur in the rules.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; a rule
whose action, host or path is null is left out (an empty host fits every host, an empty path every path);
a port or user part is part of the host and keeps it from fitting; repeated rows each get a verdict;
URLs that fit no rule get the default verdict; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_BROADCAST_RULES = 100_000
MAX_BROADCAST_CHARS = 8_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_rules(rules: Iterable[tuple[str | None, str | None, str | None]]) -> list[tuple[str, str, str]]:
    """Rules in their one form: lower-case hosts, no nulls, block before allow for one host and path."""
    lower = str.maketrans(UPPER, LOWER)
    known: dict[tuple[str, str], str] = {}
    for action, host, path in rules:
        if action is not None and host is not None and path is not None:
            key = (host.translate(lower), path)
            known[key] = "block" if "block" in (action, known.get(key)) else max(action, known.get(key, action))
    return [(action, host, path) for (host, path), action in known.items()]


def canonical_table(rules: DataFrame) -> DataFrame:
    """The same of a table: action, host and path, one row for a host and path."""
    named = rules.dropna(subset=["action", "host", "path"]).select("action", F.translate("host", UPPER, LOWER).alias("host"), F.col("path"))
    action = F.when(F.bool_or(F.col("action") == "block"), "block").otherwise(F.max("action")).alias("action")
    return named.groupBy("host", "path").agg(action).select("action", "host", "path")


class Trie:
    """Host labels from the right, then path segments; a node holds the entries that end there.

    Nodes are numbers and edges one flat table, so that a rule of any depth can be sent to the executors.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: dict[tuple[int, str], int] = {}
        self.ends: dict[int, dict[str, tuple[str, str]]] = {}
        for action, host, path in rules:
            node = 0
            for label in reversed(host.split(".") if host else []):
                node = self._below(node, "." + label)
            *whole, rest = path.split("/")
            for segment in whole:  # segments that a slash ends
                node = self._below(node, "/" + segment)
            self.ends.setdefault(node, {})[rest] = (f"{host}{path}", action)  # by what the next segment must start with
        # The lengths that occur, longest first, so that a look-up needs no pass over the entries.
        self.lengths = {node: tuple(sorted({len(e) for e in ends}, reverse=True)) for node, ends in self.ends.items()}

    def _below(self, node: int, label: str) -> int:
        return self.edges.setdefault((node, label), len(self.edges) + 1)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The rule and action of the longest match: deepest host first, then longest path."""
        best, node = (None, None), 0
        segments = path.split("/")
        for label in [None, *reversed(host.split("."))]:
            if label is not None:
                node = self.edges.get((node, "." + label))
                if node is None:
                    break
            at = node
            for k, segment in enumerate(segments):
                if at in self.ends:
                    ends = self.ends[at]
                    for n in self.lengths[at]:
                        if n <= len(segment) and segment[:n] in ends:
                            best = ends[segment[:n]]
                            break
                if k == len(segments) - 1:
                    break
                at = self.edges.get((at, "/" + segment))
                if at is None:
                    break
        return best


def _by_trie(parts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    ship(parts.sparkSession)
    shared = parts.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, action string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        find = shared.value.find
        found = [find(h, p) if h or p else (None, None) for h, p in zip(host.tolist(), path.tolist())]
        return pd.DataFrame(found, columns=["rule", "action"])

    return parts.withColumn("__hit", match("__host", "__path"))


def _by_join(parts: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by hash joins: each URL asks for its host suffixes and its path prefixes of known lengths."""
    hit = F.struct(F.concat("host", "path").alias("rule"), "action").alias("r")
    rules = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), hit)
    lengths = rules.groupBy("h").agg(F.collect_set(F.length("p")).alias("n"))
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("depth"), F.concat_ws(".", F.slice(labels, -i, i)).alias("h")))
    asked = parts.filter("__host <> '' OR __path <> ''").select("__host", "__path").distinct()
    asked = asked.withColumn("s", F.explode(F.concat(suffixes, F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("h"))))))
    asked = asked.select("__host", "__path", "s.*").join(lengths, "h").withColumn("n", F.explode("n")).filter("n <= length(__path)")
    asked = asked.withColumn("p", F.expr("substring(__path, 1, n)")).join(rules, ["h", "p"])
    best = asked.groupBy("__host", "__path").agg(F.max(F.struct("depth", "n", "r"))["r"].alias("__r"))
    out = parts.join(best, ["__host", "__path"], "left")
    return out.withColumn("__hit", F.struct(F.col("__r.rule").alias("rule"), F.col("__r.action").alias("action")))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url).

    ``rules`` are (action, host, path) triples or a table of these columns, of any length.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("__host"), path_of(F.col("url")).alias("__path"))
    if isinstance(rules, DataFrame):
        known = canonical_table(rules)
        size = known.agg(F.count("*").alias("n"), F.sum(F.length("host") + F.length("path")).alias("chars")).first()
        small = size["n"] <= MAX_BROADCAST_RULES and (size["chars"] or 0) <= MAX_BROADCAST_CHARS
        hits = _by_trie(parts, [tuple(r) for r in known.collect()]) if small else _by_join(parts, known)
    else:
        listed = canonical_rules(rules)
        small = len(listed) <= MAX_BROADCAST_RULES and sum(len(h) + len(p) for _, h, p in listed) <= MAX_BROADCAST_CHARS
        hits = _by_trie(parts, listed) if small else _by_join(parts, parts.sparkSession.createDataFrame(listed, "action string, host string, path string"))
    return hits.select(
        "page_id",
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__hit.rule").alias("rule"),
        F.coalesce(F.col("__hit.action"), F.lit(default)).alias("verdict"),
    )
