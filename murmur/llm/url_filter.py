"""URL filter: a trie over reversed host labels and path segments; the longest rule decides.

A rule is `host` + `path`, e.g. `example.org/es/`; it fits its host, all subdomains, and paths that start with its path.
Rules are compared by host labels first, then by path length: a deeper node of the trie is a longer match.

Defined cases: null url or one without `://` has empty host and path and fits nothing; a url that fits nothing gets a
null rule and the default verdict; a path rule `/` does not fit an empty path; equal rules with both verdicts block;
repeated rows are judged each; extra columns are kept, and a column named like a result is replaced; no rows give no rows."""

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A trie of at most so many rules is broadcast (about 1 kB each); more rules are joined by key.
BROADCAST_RULES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("host", "path", "rule", "verdict")


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(str.maketrans(_UPPER, _LOWER))

    @property
    def path(self) -> str:
        return "".join(self.text.partition("/")[1:])


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class _Node:
    next: dict = field(default_factory=dict)
    paths: "_Node | None" = None
    tails: list = field(default_factory=list)


class RuleTrie:
    """Host labels from the top domain down; below a host node, whole path segments; at the end an open tail."""

    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in sorted(rules, key=lambda r: (r.verdict == "allow", r.text)):  # block first: it wins between equals
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.next.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.next.setdefault(segment, _Node())
            if tail not in [t for t, _ in node.tails]:
                node.tails.append((tail, rule))
                node.tails.sort(key=lambda t: -len(t[0]))

    def find(self, host: str, path: str) -> Rule | None:
        if not host and not path:
            return None
        node, hosts = self.root, []
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.paths is not None:
                hosts.append(node.paths)
        segments = path.split("/")
        while hosts:  # deepest host first, there the deepest path
            node, best = hosts.pop(), None
            for segment in segments:
                best = next((r for t, r in node.tails if segment.startswith(t)), best)
                node = node.next.get(segment)
                if node is None:
                    break
            if best is not None:
                return best
        return None


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    known = urls.drop(*[c for c in urls.columns if c in RESULT and c != url])
    out = known.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    if len(rules) > BROADCAST_RULES:
        return _judge_by_join(out, rules, default)
    trie = urls.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            hosts, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("host", "path"))
            found = [find(h, p) for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r and r.text for r in found], pa.string()),
                 pa.array([r.verdict if r else default for r in found], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    added = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return out.mapInArrow(walk, T.StructType(out.schema.fields + added))


def _judge_by_join(urls: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same answer without a trie, for rule sets too large to broadcast.

    A url asks with its host suffixes and whole path prefixes (labels x segments keys, never pairs of rows)."""
    spark = urls.sparkSession
    table = spark.createDataFrame(
        [(r.host, r.path.rpartition("/")[0] + "/" * ("/" in r.path), r.path.rpartition("/")[2], r.path, r.text, r.verdict)
         for r in rules], "_h string, _p string, _tail string, _full string, _rule string, _verdict string",
    )
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    asked = urls.withColumn("_row", F.monotonically_increasing_id())
    keys = asked.select(
        "_row", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))).alias("_h")
    ).select(
        "_row", "path", "_h",
        F.explode(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, "").otherwise(F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.lit("/"))))).alias("_p"),
    )
    order = F.struct(F.size(F.split("_h", r"\.")), F.length("_full"), F.when(F.col("_verdict") == "block", 1).otherwise(0), F.col("_rule"))
    best = keys.join(table, ["_h", "_p"]).where(F.col("path").startswith(F.col("_full"))).groupBy("_row").agg(
        F.max_by(F.struct("_rule", "_verdict"), order).alias("_best")
    )
    return asked.join(best, "_row", "left").withColumns({
        "rule": F.col("_best._rule"), "verdict": F.coalesce("_best._verdict", F.lit(default)),
    }).drop("_row", "_best")
