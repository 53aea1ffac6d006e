"""URL rules by a sort-merge range join.

A host becomes a key of its labels in reverse order, each closed by a separator, so a rule's host
and all its subdomains are one interval of keys, and the intervals of all rules are nested or
disjoint.  URLs and rules are dealt to the same key ranges (a rule goes to every range that its
interval meets) and sorted together; one sweep per range keeps a stack of the rules whose interval
holds the current key.  Rules of one host that differ by path hang in one stack entry, with the
nearest shorter prefix of each path, so a look-up follows prefixes and never scans the rules.

URLs are dealt by host key, path and id, so a host with a third of all rows is cut into many
ranges like any other.

Cases: a null URL or one without ``://`` has empty host and path; rules with a null host are left
out, a null rule path counts as empty, an empty rule host fits every host; of equal rules ``block``
wins; of the rules that fit, the longest text (host and path) wins, then the longer host; empty
tables give empty results or the default verdict; repeated rows are judged each.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.ranges import bounds, part_of, parts_of

PARSE = r"://([^/?#]*)([^?#]*)"
END = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = "\U0010ffff"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARSE, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARSE, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.net`` -> ``net|example|www|`` (``|``: a separator that labels can't hold)."""
    safe = F.replace(F.replace(host, F.lit("\x02"), F.lit("\x02a")), F.lit(END), F.lit("\x02b"))
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), END), F.lit(END))


class HostRules:
    """All rules of one host: path look-up by nearest shorter prefix."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.verdicts, self.parents, self.chain = key, host, [], [], [], []

    def add(self, path: str, verdict: str) -> None:
        if self.paths and self.paths[-1] == path:
            return
        while self.chain and not path.startswith(self.paths[self.chain[-1]]):
            self.chain.pop()
        self.parents.append(self.chain[-1] if self.chain else -1)
        self.chain.append(len(self.paths))
        self.paths.append(path)
        self.verdicts.append(verdict)

    def find(self, path: str) -> int:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parents[i]
        return i


def sweep(default: str):
    """Sorted rows (part, key, kind, path, ..) of rules (kind 0) and URLs (kind 1) -> judged URLs."""

    def run(batches):
        stack: list[HostRules] = []
        part = None
        for batch in batches:
            out = {k: [] for k in ("id", "host", "path", "rule", "verdict")}
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist()
                    for c in ("_part", "_key", "_kind", "_host", "_path", "_id", "_verdict")]
            for p, key, kind, host, path, ident, verdict in zip(*cols, strict=True):
                if p != part:
                    part, stack = p, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(HostRules(key, host))
                    stack[-1].add(path, verdict)
                    continue
                best = (-1, -1, None, default)
                for entry in stack:
                    i = entry.find(path)
                    if i >= 0:
                        n = len(entry.host) + len(entry.paths[i])
                        best = max(best, (n, len(entry.host), entry.host + entry.paths[i], entry.verdicts[i]),
                                   key=lambda x: x[:2])
                for name, v in zip(out, (ident, host, path, best[2], best[3]), strict=True):
                    out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                 ("rule", pa.string()), ("verdict", pa.string())]))

    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", parts: int | None = None) -> DataFrame:
    """Per row of ``urls``: id, host, path, rule (text of the winning rule or null), verdict.

    ``rules`` has host, path, verdict; its size is not bounded.
    """
    parts = parts or parts_of(urls.sparkSession)
    host, path = host_of(F.col("_u")), path_of(F.col("_u"))
    u = urls.select(F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).alias("_u"))
    u = u.select("_id", host.alias("_host"), path.alias("_path")).withColumn("_key", host_key(F.col("_host")))
    place = F.concat("_key", "_path", F.lit(END), F.xxhash64("_id").cast("string"))
    cuts = bounds(u, place, parts)
    u = u.select(part_of(place, cuts).alias("_part"), "_key", F.lit(1).alias("_kind"), "_host", "_path", "_id",
                 F.lit(None).cast("string").alias("_verdict"))
    r = rules.filter(F.col("host").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("_host"), F.coalesce("path", F.lit("")).alias("_path"),
        F.col("verdict").alias("_verdict"))
    r = r.withColumn("_key", F.when(F.col("_host") == "", F.lit("")).otherwise(host_key(F.col("_host"))))
    r = r.withColumn("_part", F.explode(F.sequence(part_of(F.col("_key"), cuts),
                                                   part_of(F.concat("_key", F.lit(TOP)), cuts))))
    r = r.select("_part", "_key", F.lit(0).alias("_kind"), "_host", "_path",
                 F.lit(None).cast("bigint").alias("_id"), "_verdict")
    # "block" sorts after "allow": descending, so that of equal rules block comes first and stays
    rows = u.unionByName(r).repartition(parts, "_part").sortWithinPartitions(
        "_part", "_key", "_kind", "_path", F.col("_verdict").desc(), "_id")
    out = rows.mapInArrow(sweep(default), "id bigint, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
