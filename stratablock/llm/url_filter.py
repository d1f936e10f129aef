"""URL filter with DataFrame functions only.

A rule is a regular expression over host + path.  Rules are indexed by the
rarest of their literal tokens, as counted over the URLs themselves; each URL's
tokens fetch candidate rules, and only candidates run their expression.

Up to LITERAL_RULES rules, the index is a hash-bucketed literal in the plan: all
happens within the row, without a shuffle.  The counts that it needs are gathered, a
row per token of the rules.  More rules are a table beside the URLs: distinct hosts
with paths are split into tokens and joined with it on the token, what fits is
reduced to one rule each, and that is joined back.  Nothing of it is gathered or
broadcast, so there may be any number of rules; both ways give the same.

Null urls, and urls without "://", have empty host and path and fit no rule.
Very long urls, repeated rows, ties (same rule length: the first by name) and
empty tables are ordinary cases.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, read_table, shared_path, text_of

LITERAL_RULES = 2_000
#: Of the rules' tokens, to count them by a broadcast join; more take a shuffle.
BROADCAST_CHARS = 4_000_000
BLOCK, ALLOW = "block", "allow"
_SPLIT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name is reported (None: the rule only sets the verdict).  tokens: literal
    tokens that every fitting URL holds whole; none: the rule is tried on all."""

    action: str
    pattern: str
    tokens: tuple[str, ...] = ()
    name: str | None = None
    weight: int = 0


def quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_])", r"\\\1", text)


def host_rule(action: str, prefix: str) -> Rule:
    """Fits the host of ``host/path`` and its subdomains, where the path starts as given."""
    host, _, path = prefix.partition("/")
    # the last token of the path may go on in the URL, so only ended ones can be looked up
    ended = re.split(_SPLIT, f"{host}/{path}".lower())
    tokens = ended if re.search(r"[^A-Za-z0-9]$", prefix) else ended[:-1]
    return Rule(action, rf"^(?:[^/]*\.)?{quoted(host)}/{quoted(path)}", tuple(dict.fromkeys(t for t in tokens if t)), prefix, len(prefix))


def label_rule(action: str, label: str) -> Rule:
    """Fits hosts of which one dot-separated label is the given one."""
    tokens = tuple(t for t in re.split(_SPLIT, label.lower()) if t)
    return Rule(action, rf"^(?:[^/]*\.)?{quoted(label)}(?:\.[^/]*)?(?:/|$)", tokens)


#: Host and path rules of the production list.
HOST_RULES = (
    host_rule(BLOCK, "com/en/"),
    host_rule(ALLOW, "example.com/en/7"),
    host_rule(ALLOW, "net/de/"),
    host_rule(BLOCK, "example.net/de/8"),
    host_rule(BLOCK, "org/es/"),
)
#: Rules by host label for URLs that no rule above fits.
BLOCKED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
PRODUCTION_RULES = HOST_RULES + tuple(label_rule(BLOCK, x) for x in BLOCKED_LABELS)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(text_of(url), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), r"://[^/?#]*([^?#]*)", 1)


def _tokens(key: Column) -> Column:
    return F.array_distinct(F.split(ascii_lower(key), _SPLIT))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """rows as a table, by way of a file in the shared folder: literals of a plan would be printed and compared with it."""
    names = [c.split()[0] for c in schema.split(", ")]
    path = shared_path(spark, "rules") + ".json"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        for i in range(0, len(rows), 10_000):
            out.write("".join(json.dumps(dict(zip(names, r))) + "\n" for r in rows[i : i + 10_000]).encode())
    finally:
        out.close()
    return spark.read.schema(schema).json(path)


def rule_token_counts(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> DataFrame:
    """(token, n): in how many URLs each token of the rules occurs; none for those that don't."""
    wanted = sorted({t for r in rules for t in r.tokens})
    key = F.concat(host_of(F.col(url_col)), path_of(F.col(url_col)))
    found = pages.select(F.explode(_tokens(key)).alias("token"))
    table = _table(pages.sparkSession, [(t,) for t in wanted], "token string")
    if sum(map(len, wanted)) <= BROADCAST_CHARS:
        return found.join(F.broadcast(table), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(table.hint("merge"), "token")


def build_index(rules: tuple[Rule, ...], counts: dict[str, int]) -> tuple[list[list[tuple]], list[tuple]]:
    """Hash buckets of (token, rule), by each rule's rarest token, and the rules that have none."""
    buckets: list[list[tuple]] = [[] for _ in range(max(8, 2 * len(rules)))]
    rest = []
    for r in rules:
        if r.tokens:
            token = min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
            buckets[_bucket(token, len(buckets))].append((token, r))
        else:
            rest.append(("", r))
    return buckets, rest


def _bucket(token: str, n: int) -> int:
    h = 0
    for c in token[:4].ljust(4, "0"):
        h = h * 37 + ord(c)
    return (h + 7 * len(token)) % n


def _bucket_col(token: Column, n: int) -> Column:
    four = F.rpad(token, 4, "0")
    h = F.lit(0)
    for i in range(4):
        h = h * 37 + F.ascii(F.substring(four, i + 1, 1))
    return (h + 7 * F.length(token)) % n


_ENTRIES = "array<struct<token:string,pattern:string,weight:int,name:string,action:string>>"


def _literal(items: list[tuple[str, Rule]]) -> str:
    return json.dumps([{"token": t, "pattern": r.pattern, "weight": r.weight, "name": r.name, "action": r.action} for t, r in items])


def _first(e: Column) -> Column:
    """What the rule that decides has least of: named first, then the longest, then the first by name and action."""
    return F.struct(e["name"].isNull().alias("unnamed"), (-e["weight"]).alias("weight"), e["name"].alias("name"), e["action"].alias("action"))


def _within_the_row(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> DataFrame:
    counts = {r.token: r.n for r in rule_token_counts(pages, rules, url_col).collect()}
    buckets, rest = build_index(rules, counts)
    index = F.from_json(F.lit(f"[{','.join(map(_literal, buckets))}]"), f"array<{_ENTRIES}>")
    key = F.concat(F.col("host"), F.col("path"))
    fetched = F.flatten(F.transform(_tokens(key), lambda t: F.filter(F.element_at(index, (_bucket_col(t, len(buckets)) + 1).cast("int")), lambda e: e["token"] == t)))
    fits = F.filter(F.concat(fetched, F.from_json(F.lit(_literal(rest)), _ENTRIES)), lambda e: F.rlike(key, e["pattern"]))
    return pages.withColumn("_best", F.array_min(F.transform(fits, _first)))


def _by_joins(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> DataFrame:
    spark, key = pages.sparkSession, F.concat(F.col("host"), F.col("path"))
    numbered = _table(spark, [(i, r.pattern, r.weight, r.name, r.action) for i, r in enumerate(rules)], "rule int, pattern string, weight int, name string, action string")
    theirs = _table(spark, [(i, t, k) for i, r in enumerate(rules) for k, t in enumerate(r.tokens)], "rule int, token string, place int")
    counted = theirs.join(rule_token_counts(pages, rules, url_col).hint("merge"), "token", "left")
    rarest = counted.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("l"), "token")).alias("r")).select("rule", "r.token")
    table = cut(numbered.join(rarest, "rule", "left"), "rules")
    keys = cut(pages.select(key.alias("key")).distinct(), "url-keys")
    fetched = keys.select("key", F.explode(_tokens(F.col("key"))).alias("token")).join(table.hint("merge"), "token").filter(F.expr("rlike(key, pattern)"))
    found = fetched.select("key", _first(F.struct("name", "weight", "action")).alias("_best"))
    rest = F.from_json(F.lit(_literal([("", r) for r in rules if not r.tokens])), _ENTRIES)
    tried = F.transform(F.filter(rest, lambda e: F.rlike(F.col("key"), e["pattern"])), _first)
    found = found.unionByName(keys.select("key", F.explode(tried).alias("_best")))
    best = cut(found.groupBy("key").agg(F.min("_best").alias("_best")), "url-rules")
    return pages.withColumn("_key", key).join(best.select(F.col("key").alias("_key"), "_best").hint("merge"), "_key", "left").drop("_key")


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = PRODUCTION_RULES, url_col: str = "url", default: str = ALLOW, literal_rules: int = LITERAL_RULES) -> DataFrame:
    """All columns of pages, and host, path, rule, verdict (these replace columns so named).

    Of the named rules that fit, the longest decides; without one, the longest
    unnamed; without any, ``default``.
    """
    names = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    inner = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    url = f"c{names.index(url_col)}"
    inner = inner.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    judged = (_within_the_row if len(rules) <= literal_rules else _by_joins)(inner, rules, url)
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    return judged.select(*back, "host", "path", F.col("_best")["name"].alias("rule"), F.coalesce(F.col("_best")["action"], F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE_SQL = {
    "op5_url_filter": """
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, h, pre, action) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.action, length(r.rule)) AS action
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
  GROUP BY p.page_id, p.host, p.path)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.action, CASE WHEN list_has_any(string_split(p.host, '.'), ['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
"""
}
