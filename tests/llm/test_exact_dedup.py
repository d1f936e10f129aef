import hashlib
import random

from pyspark.sql import functions as F
from stratablock.llm.exact_dedup import exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plain(rows, best=max):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(groups[lower(t)]), keep is None or i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus():
    rng = random.Random(4)
    texts = ["", None, "A", "a", "É", "é", "İ", "x" * 50_000, "X" * 50_000, "tab\t", "tab"] + ["".join(rng.choice("abAB") for _ in range(3)) for _ in range(40)]
    return [(rng.choice([None, *range(2000)]) if k > 10 else k, rng.choice(texts)) for k in range(400)] + [(77, "same"), (77, "same"), (77, "SAME")]


def test_groups(documents):
    rows = corpus()
    assert rows_of(exact_dedup(documents(rows))) == plain(rows)
    assert rows_of(exact_dedup(documents(rows), keep="min")) == plain(rows, min)


def test_collisions(documents):
    """With a hash of the length alone, bytes have to tell texts apart."""
    rows = [(i, t) for i, t in enumerate(t for _, t in corpus())]
    weak = lambda c: F.length(c).cast("string").cast("binary")
    assert rows_of(exact_dedup(documents(rows), hash_of=weak)) == plain(rows)


def test_empty(documents):
    assert exact_dedup(documents([])).collect() == []
