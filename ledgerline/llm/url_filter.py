"""URL filters: a sort-merge range join of pages with nested host and path rules.

The labels of a host are reversed (``a.example.net`` is ``net.example.a.``), so a rule's
host and all its subdomains are one interval of keys. Pages are dealt by key ranges; a rule
goes to every range that its interval meets. Each range is sorted once and swept: a stack
holds the hosts whose intervals are open, and within a host a second stack holds the path
prefixes that are open. Keys with many pages span several ranges, and their pages are spread
over these, so no key has to fit one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.tables import table

#: Keys on the driver for each range bound; the number of ranges is the session's shuffle partitions.
SAMPLE_PER_RANGE = 40
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bounds(keyed: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """At most ranges - 1 cut points, as Spark's own range partitioner takes them from a sample."""
    most = SAMPLE_PER_RANGE * ranges
    n = keyed.count()
    fraction = min(1.0, 1.5 * most / max(n, 1))
    rows = keyed.select("host_key", "path").sample(fraction, seed=7).limit(2 * most).collect()
    keys = sorted((r.host_key.encode(), r.path.encode()) for r in rows)
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def _deal(df: DataFrame, bounds: list[tuple[bytes, bytes]], rules: bool) -> DataFrame:
    """Add ``part``: one range for a page; a row for each range that a rule's hosts meet."""
    schema = T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            take, part = [], []
            for i, (h, p) in enumerate(zip(batch.column("host_key").to_pylist(), batch.column("path").to_pylist(), strict=True)):
                key = (h.encode(), p.encode())
                if rules:
                    to = range(bisect_left(bounds, (key[0], b"")), bisect_right(bounds, (key[0] + b"\xff", b"")) + 1)
                else:  # equal keys over several ranges take turns
                    first, last = bisect_left(bounds, key), bisect_right(bounds, key)
                    turn += 1
                    to = (first + turn % (last - first + 1),)
                take += [i] * len(to)
                part += to
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(take, pa.int64())).columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return df.mapInArrow(run, schema)


class _Sweep:
    """State of the sweep through the sorted rows of one range."""

    def __init__(self) -> None:
        self.part = None

    def row(self, part: int, key: str, is_page: int, path: str, rule: str, verdict: str) -> tuple[str, str] | None:
        if part != self.part:
            self.part, self.hosts, self.at = part, [], None
        if not is_page:
            if not self.hosts or self.hosts[-1][0] != key:
                self.open_to(key)
                self.hosts.append((key, []))
            self.hosts[-1][1].append((path, rule, verdict))
            self.at = None
            return None
        if key != self.at:
            self.open_to(key)
            self.at = key
            self.waiting = sorted((r for _, own in self.hosts for r in own), key=lambda r: r[0].encode(), reverse=True)
            self.open = []
        while self.waiting and self.waiting[-1][0].encode() <= path.encode():
            first = self.waiting.pop()
            while self.open and not first[0].startswith(self.open[-1][0]):
                self.open.pop()
            self.open.append(first)
        while self.open and not path.startswith(self.open[-1][0]):
            self.open.pop()
        if not self.open:
            return None
        _, rule, verdict = max(self.open, key=lambda r: (len(r[1]), len(r[1]) - len(r[0]), r[1]))
        return rule, verdict

    def open_to(self, key: str) -> None:
        while self.hosts and not key.startswith(self.hosts[-1][0]):
            self.hosts.pop()


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = _Sweep()
    for batch in batches:
        names = ("part", "host_key", "is_page", "path", "rule", "verdict")
        found = [state.row(*x) for x in zip(*(batch.column(c).to_pylist() for c in names), strict=True)]
        pages = pc.equal(batch.column("is_page"), 1)
        out = pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array([f and f[0] for f in found], pa.string()), pa.array([f and f[1] for f in found], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])
        yield out.filter(pages)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The rule that decides each page's url, and its verdict.

    ``pages`` has page_id and url, ``rules`` has rule (``host/path``) and verdict. The longest
    fitting rule wins (of equal length, the one with the longer host); without one the verdict
    is ``default``. A url that is null or has no ``://`` has an empty host and path and fits no
    rule. Repeated pages are judged each; other columns are ignored; empty tables are fine.
    """
    spark = pages.sparkSession
    slash = F.instr("rule", "/")
    own = rules.where(F.col("rule").isNotNull() & (slash > 1)).select(
        host_key(F.expr("substring(rule, 1, instr(rule, '/') - 1)")).alias("host_key"),
        F.expr("substring(rule, instr(rule, '/'))").alias("path"),
        "rule", "verdict", F.lit(0).alias("is_page"), F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"),
    )
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = keyed.select(host_key(F.col("host")).alias("host_key"), "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"), F.lit(1).alias("is_page"), "page_id", "host")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(keyed, ranges)
    dealt = _deal(keyed, bounds, rules=False).unionByName(_deal(own, bounds, rules=True))
    swept = dealt.repartition(ranges, "part").sortWithinPartitions("part", "host_key", "is_page", "path").mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return swept.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the four production rules."""
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLES = {
    "op4_url_filter": """
WITH rules(rule, r_host, r_path, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
p AS (SELECT row_number() OVER () AS n, page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages)
SELECT p.page_id, p.host, p.path, r.rule, coalesce(r.verdict, 'allow') AS verdict
FROM p LEFT JOIN rules r ON (p.host = r.r_host OR ends_with(p.host, '.' || r.r_host)) AND starts_with(p.path, r.r_path)
QUALIFY row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule) DESC NULLS LAST, length(r.r_host) DESC) = 1
""",
}
