"""URL filter: listed hosts and paths, found by a blocked Bloom filter and an exact join.

A rule is a host and the start of a path.  It fits its host and all subdomains; of the rules
that fit, the longest wins (then the longer host; block before allow for the same rule).  A
url is cut into all keys that a rule could have: every ending of its host after a dot that is
as long as some rule's host, with every start of its path as long as some rule's path.  Keys that pass the Bloom filter join
the rules exactly, which removes false hits.

A null url, or one without ``://``, has an empty host and path, and no rule.  Urls of any
length and any number of labels are cut into as many keys as the rules have lengths.
Repeated rows are judged each; an empty table has no rows; columns not kept are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bloom import build_filter, might_hold
from tallyspark.session import stage

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Canonical host (A-Z folded) and path of a url; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _UPPER.lower()), F.coalesce(path, F.lit(""))


def candidate_keys(host: str, path: str, host_sizes: list[int], path_sizes: list[int]) -> list[str]:
    """Every key a fitting rule can have: as many host endings as rules have lengths of hosts."""
    n = len(host)
    ends = [host[n - k:] for k in host_sizes if k == n or (k < n and host[n - k - 1] == ".")]
    return [e + path[:k] for e in ends for k in path_sizes if k <= len(path)]


def _possible(blocks: np.ndarray, host_sizes: list[int], path_sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            each = [candidate_keys(h, p, host_sizes, path_sizes) for h, p in zip(hosts, paths)]
            row = np.repeat(np.arange(len(each)), [len(k) for k in each])
            keys = [k for found in each for k in found]
            hashes = np.array([xxhash.xxh64_intdigest(k.encode(), seed=42) for k in keys], dtype=np.uint64)
            hits = np.flatnonzero(might_hold(blocks, hashes))
            rows = pa.array(row[hits])
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(rows), batch.column("path").take(rows), pa.array([keys[i] for i in hits], pa.string())],
                names=["host", "path", "key"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns ``keep``, with host, path, rule and verdict.

    ``rules`` has host, path and verdict.  Every distinct host and path is judged once.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path"))
    listed = stage(
        rules.select(F.concat(F.translate("host", _UPPER, _UPPER.lower()), "path").alias("rule"), F.length("host").alias("host_size"),
                     F.length("path").alias("path_size"), "verdict")
        .groupBy("rule").agg(F.max("verdict").alias("verdict"), F.max("host_size").alias("host_size"), F.max("path_size").alias("path_size")),
        "url-rules",
    )
    sizes = listed.agg(F.sort_array(F.collect_set("host_size")), F.sort_array(F.collect_set("path_size"))).first()
    blocks = build_filter(listed, F.xxhash64("rule"))
    possible = rows.select("host", "path").distinct().mapInArrow(_possible(blocks, *sizes), "host string, path string, key string")
    best = F.max(F.struct(F.length("rule").alias("size"), "host_size", "rule", "verdict")).alias("best")
    judged = (
        possible.join(listed, F.col("key") == F.col("rule")).groupBy("host", "path").agg(best)
        .select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best.rule", "best.verdict")
    )
    return (
        rows.join(judged, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
        .select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )
