import random
import re

import pytest
from pyspark.sql import functions as F
from stratablock.llm.url_filter import ALLOW, BLOCK, BLOCKED_LABELS, HOST_RULES, PRODUCTION_RULES, Rule, build_index, host_rule, url_filter


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, action in [("com/en/", BLOCK), ("example.com/en/7", ALLOW), ("net/de/", ALLOW), ("example.net/de/8", BLOCK), ("org/es/", BLOCK)]:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, action)
    verdict = best[1] if best else BLOCK if set(host.split(".")) & set(BLOCKED_LABELS) else ALLOW
    return host, path, best[0] if best else None, verdict


def urls():
    rng = random.Random(2)
    hosts = ["example.com", "www.Example.COM", "a.example.net", "example.net", "notexample.net", "x.org", "com", "net", "m.spam-farm.example.org", "spam-farmer.org", "adult-x.net", "é.com", "example.com:80", ""]
    paths = ["", "/", "/en/", "/en", "/en/7", "/en/742/x", "/EN/7", "/de/8", "/de/85", "/de/", "/es/1", "/es", "?q=/en/7", "#/en/", "/en/7?x#y", "/a/en/7"]
    made = [f"{rng.choice(['http', 'https', 'FTP'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return [*made, None, "", "example.com/en/7", "://", "http://", "http://a://b/en/7", "http://x.com/en/" + "z" * 100_000, "http://x.org/es/\nq", made[0], made[0]]


@pytest.mark.parametrize("literal", [2000, 0], ids=["within the row", "by joins"])
def test_verdicts(spark, literal):
    rows = [(i if i % 9 else None, u, "x", 1) for i, u in enumerate(urls())]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, token int")
    out = url_filter(df.withColumns({x: F.lit(7) for x in ("key", "_best", "_key", "name", "c0", "n", "Host")}).repartition(3), literal_rules=literal)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u, _, _ in rows), key=str)
    assert [c for c in out.columns if c.lower() in ("host", "rule")] == ["host", "rule"]
    assert url_filter(spark.createDataFrame([], "page_id long, url string"), literal_rules=literal).count() == 0


@pytest.mark.parametrize("literal", [2000, 0], ids=["within the row", "by joins"])
def test_rules_without_tokens_and_ties(spark, literal):
    rules = (Rule(BLOCK, "q+$", (), None, 1), host_rule(ALLOW, "a.b/"), Rule(BLOCK, r"^a\.b/", ("a", "b"), "a.b_", 4), Rule(BLOCK, r"/z/", ("z",), None, 9))
    df = spark.createDataFrame([(1, "x://a.b/qq"), (2, "x://c/qq"), (3, "x://c/z/"), (4, "x://c/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(df, rules, literal_rules=literal).collect()}
    assert got == {1: ("a.b/", ALLOW), 2: (None, BLOCK), 3: (None, BLOCK), 4: (None, ALLOW)}


def test_index_takes_the_rarest_whole_token():
    buckets, rest = build_index(PRODUCTION_RULES, {"example": 900, "com": 500, "en": 700})
    where = {r.name or r.pattern: t for b in buckets for t, r in b}
    assert not rest and where["example.com/en/7"] == "com" and where["com/en/"] == "com"
    assert "7" not in host_rule(ALLOW, "example.com/en/7").tokens and len(HOST_RULES) == 5


def test_many_rules(spark):
    """As many rules as no plan should hold, of which each URL fits one at most."""
    rules = tuple(host_rule(BLOCK, f"h{i}.example.com/en/") for i in range(25_000))
    df = spark.createDataFrame([(i, f"http://x.h{i}.example.com/en/{i}") for i in range(24_900, 25_100)], "page_id long, url string")
    out = url_filter(df, rules)
    got = {r.page_id: r.rule for r in out.collect()}
    assert got == {i: f"h{i}.example.com/en/" if i < 25_000 else None for i in range(24_900, 25_100)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
