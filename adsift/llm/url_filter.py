"""URL filter: a trie over reversed host labels and path segments.

A rule is a host with a path prefix; it fits the host and its subdomains.  The
trie has a node for each host label, from the top-level domain down, and below a
host's node one for each whole path segment; what a rule's path has after its last
slash is kept at that node, since it may end inside a segment.  A lookup walks the
url once and collects all rules that fit; the longest wins, whether it allows or
blocks.

The rules are broadcast, up to a documented size.  Larger rule lists go through an
equi-join on every host suffix and path prefix a rule could have, so neither way
compares each url with each rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsift.llm.common import ascii_lower, own_columns

#: Up to so many bytes of rule text the trie is broadcast.
BROADCAST_BYTES = 32 << 20
DEFAULT_VERDICT = "allow"


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: What a rule's path has below this node: (text, rule, verdict).
    ends: list[tuple[str, str, str]] = field(default_factory=list)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> Node:
    """Rules are ``(host, path prefix, verdict)``."""
    root = Node()
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, end = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        node.ends.append((end, host + path, verdict))
    return root


def longest_match(root: Node, host: str, path: str) -> tuple[str | None, str | None]:
    """The rule that fits and its verdict; of equally long ones block, then the first."""
    best: tuple = (-1, False, "")
    found: tuple[str | None, str | None] = (None, None)
    parts = path.split("/")
    node: Node | None = root
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        inner: Node | None = node
        for segment in parts:
            for end, rule, verdict in inner.ends:
                rank = (len(rule), verdict == "block", rule)
                if segment.startswith(end) and rank > best:
                    best, found = rank, (rule, verdict)
            inner = inner.segments.get(segment)
            if inner is None:
                break
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of an absolute url; empty without ``://``."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    known = F.coalesce(url, F.lit(""))
    return (
        ascii_lower(F.regexp_extract(known, pattern, 1)),
        F.regexp_extract(known, pattern, 2),
    )


def _by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(build_trie(rules))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value
        for batch in batches:
            host = batch.column("host").to_pylist()
            path = batch.column("path").to_pylist()
            found = [longest_match(root, h, p) for h, p in zip(host, path)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([r for r, _ in found], pa.string()),
                    pa.array([v or default for _, v in found], pa.string()),
                ],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return urls.mapInArrow(
        walk, "page_id long, host string, path string, rule string, verdict string"
    )


def _by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same, for rule lists of any size."""
    keyed = rules.select(
        F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"
    ).distinct()
    # Lengths of rule paths: as many as the longest path has characters at most.
    lengths = keyed.select(F.length("rule_path").alias("n")).distinct()
    lengths = F.array(*[F.lit(r["n"]) for r in lengths.collect()]).cast("array<int>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    able = F.filter(lengths, lambda n: n <= F.length("path"))
    pairs = urls.select("host", "path").distinct()
    tried = pairs.withColumn("rule_host", F.explode(suffixes)).select(
        "host", "path", "rule_host",
        F.explode(F.transform(able, lambda n: F.left(F.col("path"), n))).alias("rule_path"),
    )
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule), F.col("verdict") == "block", rule)
    best = (
        tried.join(keyed, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(rule.alias("rule"), "verdict"), rank).alias("found"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame | list[tuple[str, str, str]],
    default: str = DEFAULT_VERDICT,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of every page.

    ``rules`` are ``(host, path, verdict)`` rows.  Without a fitting rule the
    rule is null and the verdict the default, which also holds for null urls
    and those without ``://``, whose host and path are empty.
    """
    own = own_columns(pages, page_id="long", url="string")
    host, path = host_and_path(own["url"])
    urls = pages.select(own["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, list):
        return _by_trie(urls, rules, default)
    size = rules.agg(
        F.sum(F.octet_length("host") + F.octet_length("path") + 64).alias("bytes")
    ).first()["bytes"]
    if (size or 0) <= broadcast_bytes:
        listed = rules.select("host", "path", "verdict").collect()
        return _by_trie(urls, [tuple(r) for r in listed], default)
    return _by_join(urls, rules, default)
