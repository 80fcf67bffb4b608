"""URL filter on a sorted digest array.

The rules' host and path strings are hashed by 64-bit xxhash and stored as a sorted array beside
their strings and where these begin; tasks map all three files into memory, and read a string only when its digest is met. A page's candidate strings (each parent domain of
its host with each rule length of its path) are hashed, probed by vectorised binary search, and a
hit counts only if the stored string is the same. Rule sets over ``MAX_RULE_BYTES`` are not shipped
to every executor but joined on their digests, with the same results: a bound on what is shipped, beyond which there is another way.

Defined results: a null url or one without ``://`` has an empty host and path; the longest fitting rule
wins, then the longer host, then (of rules for one host and path) the greater verdict, which is ``block``; without a fitting rule the verdict is the default. Repeated rows are
judged each; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]
MAX_RULE_BYTES = 64 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def digest_files(rules: Sequence[Rule], folder: str) -> tuple[str, str, str]:
    """Write the sorted digest array, the bounds of the strings in its order (and the paths' lengths), and the strings themselves."""
    keyed = sorted((xxhash.xxh64_intdigest(f"{host}\n{path}"), host, path, verdict) for verdict, host, path in rules)
    name = os.path.join(folder, uuid.uuid4().hex)
    texts = [json.dumps(k[1:]).encode() for k in keyed]
    lengths = sorted({len(path) for _, _, path, _ in keyed})
    np.array([k[0] for k in keyed], "<u8").tofile(f"{name}.u64")
    np.array([len(lengths), *lengths, *np.cumsum([0, *map(len, texts)])], "<i8").tofile(f"{name}.i64")
    with open(f"{name}.txt", "wb") as out:
        out.write(b"".join(texts) or b"\n")
    return f"{name}.u64", f"{name}.i64", f"{name}.txt"


class DigestArray:
    """The sorted digests, mapped into memory, and what they stand for."""

    def __init__(self, digests: str, bounds: str, strings: str):
        numbers = np.memmap(bounds, "<i8", "r")
        self.path_lengths = numbers[1 : 1 + int(numbers[0])].tolist()
        self.bounds = numbers[1 + int(numbers[0]) :]
        self.strings = np.memmap(strings, np.uint8, "r")
        self.digests = np.memmap(digests, "<u8", "r") if len(self.bounds) > 1 else np.empty(0, "<u8")

    def entry(self, k: int) -> tuple[str, str, str]:
        """Host, path and verdict of the ``k``-th digest."""
        return tuple(json.loads(self.strings[self.bounds[k] : self.bounds[k + 1]].tobytes()))

    def candidates(self, host: str, path: str) -> list[tuple[str, str]]:
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        return [(h, path[:n]) for h in hosts for n in self.path_lengths if n <= len(path)]

    def judge(self, pages: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """For each (host, path) its longest rule and that rule's verdict."""
        keys = [self.candidates(*p) for p in pages]
        flat = [k for own in keys for k in own]
        probe = np.fromiter((xxhash.xxh64_intdigest(f"{h}\n{p}") for h, p in flat), np.uint64, len(flat))
        at = np.searchsorted(self.digests, probe)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probe) if len(self.digests) else []
        owner = np.repeat(np.arange(len(pages)), [len(own) for own in keys])
        best: list[tuple] = [(-1, -1, None, None)] * len(pages)
        for i in hit:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == probe[i]:  # digests that collide stand side by side
                host, path, verdict = self.entry(k)
                if (host, path) == flat[i]:
                    best[owner[i]] = max(best[owner[i]], (len(host) + len(path), len(host), host + path, verdict))
                k += 1
        return [b[2:] for b in best]


_OPEN: dict[str, DigestArray] = {}


def _judge(digests: str, bounds: str, strings: str, default: str):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digests not in _OPEN:
            _OPEN[digests] = DigestArray(*map(SparkFiles.get, (digests, bounds, strings)))
        for batch in batches:
            found = _OPEN[digests].judge(list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r for r, _ in found], pa.string()), pa.array([v or default for _, v in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    return judge


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", max_rule_bytes: int = MAX_RULE_BYTES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 16), F.lit(0))).first()[0]
        if size > max_rule_bytes:
            return _joined(split, rules, default)
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]  # at most ``max_rule_bytes``
    files = digest_files(rules, tempfile.mkdtemp(prefix="quantloom-rules-"))
    for f in files:
        spark.sparkContext.addFile(f)
    return split.mapInArrow(_judge(*map(os.path.basename, files), default), "page_id long, host string, path string, rule string, verdict string")


def _joined(split: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join on digests, for rule sets that are too large to ship."""
    rules = rules.select(F.xxhash64("host", "path").alias("digest"), F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().collect()]  # no more than a path has characters
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = split.select("host", "path").distinct()
    keys = (
        urls.withColumn("r_host", F.explode(hosts)).withColumn("n", F.explode(F.array(*map(F.lit, lengths))))
        .where("n <= length(path)").withColumn("r_path", F.expr("substring(path, 1, n)")).withColumn("digest", F.xxhash64("r_host", "r_path"))
    )
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_verdict")
    best = keys.join(rules, ["digest", "r_host", "r_path"]).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
