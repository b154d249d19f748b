"""URL filter: allow and block rules in a trie, the longest match decides.

The trie's first levels are host labels from the top-level domain down, its
last levels path segments; a rule's path that ends inside a segment is kept as
that segment's beginning. A walk notes every rule on its way, so the last one
noted is the longest match, be it an allow or a block rule.

A list of up to ``TRIE_RULES`` rules is broadcast as a trie; a longer one is
never brought to the driver: then each different host and path is joined with
the rules by its own suffixes and prefixes.

Defined results: null and anything without ``://`` have an empty host and an
empty path, which no rule with a host fits, and take the default verdict. Of
equal rules with different actions, block wins. Rules with a null host or path
count as empty there; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdikt.llm.rows import free

TRIE_RULES = 200_000
#: What a url that no rule fits gets.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path, both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


@dataclass
class Node:
    """A place in the trie."""

    below: dict[str, Node] = field(default_factory=dict)
    #: Rules whose path ends inside the next segment: its beginning -> rule.
    begins: dict[str, tuple[str, str]] = field(default_factory=dict)
    paths: Node | None = None


class Trie:
    def __init__(self, rules: Iterator[tuple[str, str, str]]) -> None:
        self.top = Node()
        for host, path, action in rules:
            node = self.top
            for label in reversed(host.split(".")) if host else ():
                node = node.below.setdefault(label, Node())
            node.paths = node.paths or Node()
            node = node.paths
            *whole, begin = path.split("/")
            for segment in whole:
                node = node.below.setdefault(segment, Node())
            if node.begins.get(begin, ("", ""))[1] != "block":
                node.begins[begin] = (host + path, action)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule: most host labels first, then most of the path."""
        found, node = None, self.top
        labels = reversed(host.split(".")) if host else iter(())
        while node is not None:
            found = self._along(node.paths, path) or found
            label = next(labels, None)
            node = node.below.get(label) if label is not None else None
        return found

    @staticmethod
    def _along(node: Node | None, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for k, segment in enumerate(segments):
            if node is None:
                break
            if node.begins:
                for end in range(len(segment) + 1):
                    found = node.begins.get(segment[:end], found)
            node = node.below.get(segment) if k < len(segments) - 1 else None
        return found


def _cleaned(rules: DataFrame) -> DataFrame:
    """``host, path, action``, one row per host and path."""
    rows = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("action"),
    )
    # "block" is the larger of the two words.
    return rows.groupBy("host", "path").agg(F.max("action").alias("action"))


def _by_trie(urls: DataFrame, rules: DataFrame, into: str) -> DataFrame:
    made = Trie(tuple(r) for r in rules.select("host", "path", "action").toLocalIterator())
    trie = urls.sparkSession.sparkContext.broadcast(made)

    @F.pandas_udf("rule string, action string")
    def find(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [trie.value.find(h, p) or (None, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "action"], dtype=object)

    return urls.withColumn(into, find("host", "path"))


def _by_join(urls: DataFrame, rules: DataFrame, into: str) -> DataFrame:
    """The same by joins on each url's host suffixes and path beginnings.

    Only path beginnings of lengths that rules have are tried, and each
    different host and path once.
    """
    lengths = rules.select(F.length("path").alias("_long")).distinct()
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    pairs = pairs.withColumn("_host", F.explode(F.array_distinct(F.concat(suffix, F.array(F.lit(""))))))
    hosts = pairs.join(rules.select(F.col("host").alias("_host")).distinct(), "_host", "left_semi")
    tried = hosts.join(lengths, F.col("_long") <= F.length("path")).withColumn("_path", F.expr("substring(path, 1, _long)"))
    known = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "action")
    best = F.max_by(
        F.struct(F.concat("_host", "_path").alias("rule"), "action"), F.struct(F.length("_host"), F.length("_path"))
    )
    found = tried.join(known, ["_host", "_path"]).groupBy("host", "path").agg(best.alias(into))
    return urls.join(found, ["host", "path"], "left")


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT, trie_rules: int = TRIE_RULES) -> DataFrame:
    """Adds ``host, path, rule, verdict``; columns of these names are replaced.

    ``rules`` has ``host, path, action`` with the actions allow and block.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.withColumns({"host": host, "path": path})
    rules = _cleaned(rules)
    few = rules.limit(trie_rules + 1).count() <= trie_rules
    match = free(pages) + "match"
    found = (_by_trie if few else _by_join)(urls, rules, match)
    added = {"rule": F.col(f"{match}.rule"), "verdict": F.coalesce(F.col(f"{match}.action"), F.lit(default))}
    return found.withColumns(added).drop(match)
