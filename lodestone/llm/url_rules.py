"""URL filter: a sort-merge range join of urls with nested prefix rules.

A rule (host, path) covers one interval of keys: its host's labels reversed, then its path. Within
one host two such intervals nest or are apart, so a sweep over rules and urls in key order needs only
a stack of the rules that are open. A url is entered once for each ancestor of its host that can have
rules: a rule with a path covers subdomains too, and these don't adjoin in key order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import UPPER, read, shared_dir, written

#: Rules of the registered query: host, path, verdict (fixed values).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
DEFAULT = "allow"
#: Stands behind each label of a key, below every other character, so that a host sorts before its children.
STOP = "\x01"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host behind the first :// up to / ? # or end, A-Z lower-cased; path from there up to ? # or end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def host_key(labels: Column) -> Column:
    return F.concat(F.array_join(F.reverse(labels), STOP), F.lit(STOP))


def _open(stack: list[tuple], key: str) -> None:
    while stack and not key.startswith(stack[-1][0]):
        stack.pop()


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in ("key", "is_url", "rid", "rule", "verdict", "width")], strict=True)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range: its number, its last key and the rules of its own that are open there."""
    stack: list[tuple] = []
    last = None
    for batch in batches:
        for last, is_url, _, *rule in _rows(batch):
            if not is_url:
                _open(stack, last)
                stack.append((last, *rule))
    if last is not None:
        _open(stack, last)
        data = [[TaskContext.get().partitionId()], [last], [[dict(zip(("key", "rule", "verdict", "width"), s, strict=True)) for s in stack]]]
        kind = pa.list_(pa.struct([("key", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("width", pa.int64())]))
        types = [pa.int32(), pa.string(), kind]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types, strict=True)], names=["part", "last", "open"])


def _sweep(begin: dict[int, list[tuple]]):
    """The innermost open rule at each url's key; begin: what is open where a range begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = list(begin.get(TaskContext.get().partitionId(), ()))
        for batch in batches:
            out: list[tuple] = []
            for key, is_url, rid, *rule in _rows(batch):
                _open(stack, key)
                if not is_url:
                    stack.append((key, *rule))
                elif stack:
                    out.append((rid, *stack[-1][1:]))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64())
            arrays = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "rule", "verdict", "width"])

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """Judges every url by the longest rule that fits it.

    rules has host, path and verdict; a rule fits urls of its host and all subdomains whose path begins
    with its path. Longest means most characters of host and path together, then the longer host.
    Of rules with equal host and path the least verdict holds; rules with a null are ignored, and a rule's host is lower-cased.

    Returns one row for each row of pages: page_id, host, path, rule (host and path of the rule, else
    null), verdict (the rule's, else ``default``). A null url and one without :// have empty host and
    path and fit no rule. Ids may be null or repeated; further columns are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    shared_dir(spark)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = written(urls.withColumn("rid", F.monotonically_increasing_id()), "url-rows")
    labels = F.split("host", r"\.")
    known = rules.select(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path", "verdict").dropna()
    known = known.filter("host <> ''").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    known = known.withColumn("key", F.concat(host_key(labels), "path")).withColumn("depth", F.size(labels))
    rule = F.concat("host", "path")
    width = F.length("host") + F.length(rule) * F.lit(1024).cast("long")
    known = written(known.select("key", "depth", rule.alias("rule"), "verdict", width.alias("width")), "url-rules")
    # How many labels a rule's host can have: 127 at most by the rules of domain names, whatever the table's size.
    depths = [r[0] for r in known.select("depth").distinct().collect()]
    wanted = F.filter(F.array(*[F.lit(d) for d in depths]).cast("array<int>"), lambda d: d <= F.size(labels))
    entries = urls.filter("host <> ''").select("rid", "path", labels.alias("labels"), F.explode(wanted).alias("depth"))
    key = F.concat(host_key(F.slice("labels", -F.col("depth"), F.col("depth"))), "path")
    none = F.lit(None)
    no = {"rule": "string", "verdict": "string", "width": "long"}
    entries = entries.select(key.alias("key"), F.lit(True).alias("is_url"), "rid", *[F.lit(None).cast(t).alias(c) for c, t in no.items()])
    starts = known.select("key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("rid"), *no)
    order = ["key", "is_url", "rid"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A checkpoint, as its partitions stay the ranges that they are.
    dealt = starts.unionByName(entries).repartitionByRange(parts, *order).sortWithinPartitions(*order).checkpoint()
    swept = dealt.mapInArrow(_sweep(_begin(dealt)), "rid long, rule string, verdict string, width long")
    best = swept.groupBy("rid").agg(F.max(F.struct("width", "rule", "verdict")).alias("best"))
    out = urls.join(best, "rid", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _begin(dealt: DataFrame) -> dict[int, list[tuple]]:
    """The rules that are open where each range begins: one row of nested rules for each range reaches the driver."""
    ends = dealt.mapInArrow(_ends, "part int, last string, open array<struct<key:string,rule:string,verdict:string,width:bigint>>")
    out, stack = {}, []
    for part, last, own in sorted(ends.collect()):
        out[part] = list(stack)
        _open(stack, last)
        stack += [tuple(r) for r in own]
    return out


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, verdict string"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b AS (
  SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (rid)
"""
