"""URL filter over a sorted digest array (operator 7).

The list of rules is one file in the shared folder: sorted 64-bit xxhash keys, offsets, verdicts
and the full strings. Spark hands the file to every executor; workers memory-map it, probe it
with a vectorised binary search for each host suffix joined with each prefix of the path that
some rule is as long as, and confirm a hit by comparing the stored string.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_root, table

#: The rules of the contract.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest_file(rules: dict[str, str]) -> bytes:
    """count, path lengths, sorted keys, string offsets, verdict bytes, strings."""
    from xxhash import xxh64_intdigest

    rows = sorted((xxh64_intdigest(k.encode()), k.encode(), v) for k, v in rules.items())
    lengths = sorted({len(k) - k.index(b"/") for _, k, _ in rows})
    offsets = np.cumsum([0, *(len(k) for _, k, _ in rows)]).astype(np.uint64)
    head = np.array([len(rows), len(lengths), *lengths], np.uint64)
    return b"".join([head.tobytes(), np.array([h for h, _, _ in rows], np.uint64).tobytes(), offsets.tobytes(), bytes(v == "block" for _, _, v in rows), b"".join(k for _, k, _ in rows)])


class Digests:
    """The mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in raw[:16].view(np.uint64))
        at = 16 + 8 * m
        self.lengths = raw[16:at].view(np.uint64).tolist()
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        self.offsets = raw[at + 8 * n : at + 16 * n + 8].view(np.uint64)
        self.block = raw[at + 16 * n + 8 : at + 17 * n + 8]
        self.text = raw[at + 17 * n + 8 :]

    def stored(self, i: int) -> bytes:
        return self.text[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, bool] | None]:
        """For each url its longest rule and whether that blocks."""
        from xxhash import xxh64_intdigest

        row, cand = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            raw = path.encode()
            parts = host.encode().split(b".")
            for n in self.lengths:
                if n <= len(raw):
                    for j in range(len(parts)):
                        row.append(i)
                        cand.append(b".".join(parts[j:]) + raw[:n])
        found: list = [None] * len(hosts)
        if not cand or not len(self.keys):
            return found
        keys = np.fromiter(map(xxh64_intdigest, cand), np.uint64, len(cand))
        spot = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero(self.keys[np.minimum(spot, len(self.keys) - 1)] == keys)
        for c in hits.tolist():
            s = int(spot[c])
            while s < len(self.keys) and self.keys[s] == keys[c]:  # equal keys of different strings stand together
                if self.stored(s) == cand[c]:
                    i, text = row[c], cand[c].decode()
                    if found[i] is None or len(text) > len(found[i][0]):
                        found[i] = text, bool(self.block[s])
                s += 1
        return found


def _judge(name: str):
    def run(batches):
        from pyspark import SparkFiles

        digests = Digests(SparkFiles.get(name))
        for b in batches:
            hit = digests.longest(b.column(1).to_pylist(), b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array([h and h[0] for h in hit], pa.string()), pa.array([DEFAULT if h is None else ("block" if h[1] else "allow") for h in hit], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def share_rules(spark: SparkSession, rules: dict[str, str]) -> str:
    """Put the digest file in the shared folder and have Spark hand it to the executors."""
    name = f"loom-urls-{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p)
    out.write(bytearray(digest_file(rules)))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A rule ``host/path`` fits its host and subdomains where the url's path starts with the
    rule's path; the longest rule wins. Null urls and urls without ``://`` have an empty host and
    path and fit no rule; a url that fits none is allowed. Repeated rows and null ids each get a
    row; an empty table gives none. Columns other than the two named are not read.
    """
    name = share_rules(pages.sparkSession, RULES if rules is None else rules)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).mapInArrow(
        _judge(name), "page_id long, host string, path string, rule string, verdict string"
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE
  WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
