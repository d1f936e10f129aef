import random

import numpy as np
import pytest
import xxhash
from stratablock.llm.components import connected_components
from stratablock.llm.simhash import SEARCH_BANDS, SEARCH_ROWS, band_keys, bucket_links, fingerprint, forest, near_duplicates, pigeonhole, set_fingerprint, set_links, shingle_hashes, simhash_components


def plain_shingles(text, words):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []


def plain_fingerprint(text, words=3):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in plain_shingles(text, words)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


def test_fingerprint():
    rng = random.Random(3)
    for text in ["", " \n", "One", "One two", "A b\tC\n d", "Été à b", *(prose(rng, 40).title() for _ in range(30)), prose(rng, 3) * 2000]:
        assert int.from_bytes(fingerprint(shingle_hashes(text, 3)), "little") == plain_fingerprint(text)
    assert len(fingerprint(shingle_hashes("a b c d", 3), 4)) == 32


@pytest.mark.parametrize("radius,sizes", [(2, [1, 2, 3, 5, 64, 65, 130]), (9, [200, 1, 70, 2]), (0, [3, 2])])
def test_bucket_links(radius, sizes):
    rng = np.random.default_rng(5)
    keys, fps = [], []
    for g, n in enumerate(sizes):
        base = int(rng.integers(0, 1 << 62))
        for _ in range(n):
            flips = sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 2 * radius + 2)), replace=False))
            keys.append(g)
            fps.append(base ^ flips)
    raw = np.array(fps, "<u8").view(np.uint8).reshape(-1, 8)
    a, b = bucket_links(np.array(keys), raw, radius)
    want = plain_components(len(fps), lambda x, y: keys[x] == keys[y] and (fps[x] ^ fps[y]).bit_count() <= radius)
    edges = set(zip(a.tolist(), b.tolist()))
    got = plain_components(len(fps), lambda x, y: (x, y) in edges or (y, x) in edges)
    assert got == want
    assert len(a) <= len(fps)


def test_links_stay_linear():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2, 256)
    ones = np.array([base ^ (rng.random(256) < 0.06) for _ in range(400)])
    raw = np.packbits(ones.astype(np.uint8), axis=1, bitorder="little")
    assert len(bucket_links(np.zeros(400, np.int64), raw, 64)[0]) == 399


def test_band_keys():
    """As many keys in common as the similarity says; equal sets have all, whatever their order and repeats."""
    rng = np.random.default_rng(2)
    shared = 0
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 220).astype(np.uint64)
        a, b = band_keys(h[:200], 20, 2), band_keys(np.concatenate([h[20:], h[30:60]]), 20, 2)
        shared += int((a == b).sum())
    expected = (180 / 220) ** 2
    assert abs(shared / 8000 - expected) < 0.02
    assert band_keys(h, 12, 4).tolist() == band_keys(np.concatenate([h[::-1], h]), 12, 4).tolist()
    assert len(set(band_keys(h, 12, 4).tolist())) == 12 == len(band_keys(np.zeros(0, np.uint64), 12, 4))
    assert 1 - (1 - 0.8**SEARCH_ROWS) ** SEARCH_BANDS > 0.998


def test_pigeonhole_misses_nothing():
    for radius in (0, 1, 2, 3):
        tables = pigeonhole(radius)
        rng = random.Random(radius)
        for _ in range(500):
            flipped = set(rng.sample(range(64), radius))
            assert any(flipped.isdisjoint(t) for t in tables)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (7, 7), (20, 5), (30, 31), (31, 32), (32, 30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 20: 1, 10: 10, 11: 10, 30: 30, 31: 30, 32: 30}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = random.Random(9)
    rows = [(100, None), (101, ""), (102, " \n"), (50, "Hello there you"), (51, "hello THERE  you"), (51, "hello THERE  you")]
    for g in range(12):
        base = prose(rng, rng.choice([30, 200, 400])).split()
        for c in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 8])):
                w[rng.randrange(len(w))] = prose(rng, 1)
            rows.append((1000 + 10 * g + c, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile_rows", [8192, 4])
def test_simhash_components(documents, tile_rows):
    rows = corpus()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    roots = plain_components(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    want = sorted((i, f"{f:016x}", min(rows[k][0] for k in range(len(rows)) if roots[k] == r)) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted(map(tuple, simhash_components(documents(rows), tile_rows=tile_rows).collect())) == want


def test_simhash_empty_and_null_ids(documents):
    assert simhash_components(documents([])).count() == 0
    got = sorted(map(tuple, simhash_components(documents([(None, "a b"), (4, "a b"), (None, "zz")])).collect()), key=str)
    assert {(r[0], r[2]) for r in got} == {(4, 4), (None, 4), (None, None)} and len(got) == 3


def test_near_duplicates(documents):
    rows = corpus()
    sets = [set(plain_shingles(t or "", 5)) for _, t in rows]

    def similar(a, b):
        u = sets[a] | sets[b]
        return not u or len(sets[a] & sets[b]) >= 0.8 * len(u)

    roots = plain_components(len(rows), similar)
    want = sorted((i, min(rows[k][0] for k in range(len(rows)) if roots[k] == r)) for (i, _), r in zip(rows, roots))
    got = sorted((r[0], r[2]) for r in near_duplicates(documents(rows)).collect())
    same = sum(a == b for a, b in zip(got, want))
    assert len(got) == len(want) and same >= 0.95 * len(want)


def exact_classes(sets, similarity=0.8):
    """Brute force over all pairs: the smallest row of each row's class."""
    names = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    ones = np.zeros((len(sets), len(names)), np.float32)
    for i, s in enumerate(sets):
        ones[i, [names[x] for x in s]] = 1
    sizes, common = ones.sum(1), ones @ ones.T
    a, b = np.nonzero(np.triu(common >= similarity * (sizes[:, None] + sizes[None] - common), 1))
    return forest(len(sets), a, b)


def star(rng, copies, words=300, edits=6):
    """A text and copies of it, each with edits of its own: 0.816 similar to it, and mostly 0.67 to each other."""
    base = prose(rng, words).split()
    rows = [(copies, " ".join(base))]
    for c in range(copies):
        w = list(base)
        for k in rng.sample(range(6, words - 6, 6), edits):
            w[k] = f"q{c}x{k}"
        rows.append((c, " ".join(w)))
    return rows


def test_set_links():
    rng = random.Random(4)
    for labelled in (False, True):
        for _ in range(40):
            base = [rng.sample(range(400), 60) for _ in range(3)]
            sets = [set(rng.choice(base)) ^ set(rng.sample(range(400), rng.randint(0, 9))) for _ in range(rng.randint(1, 60))]
            want = exact_classes(sets)
            labels = np.where(np.arange(len(sets)) % 3 == 0, want, np.arange(len(sets))) if labelled else np.arange(len(sets))
            a, b = set_links(np.concatenate([np.array(sorted(s), np.int64) for s in sets]), np.array([len(s) for s in sets]), labels, 0.8)
            assert all(5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for i, j in zip(a, b))
            at = np.arange(len(sets))
            assert forest(len(sets), np.concatenate([a, at]), np.concatenate([b, labels])).tolist() == want.tolist()
            assert len(a) < len(sets)


def test_star_of_near_copies(documents):
    """Many copies are closer to each other by their bits than to the text they come from; only that one links them."""
    rng = random.Random(6)
    rows = star(rng, 1200)
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    want = exact_classes(sets)
    assert sum(want == 0) == 1201
    ids = [i for i, _ in rows]
    named = {r: min(ids[k] for k in np.flatnonzero(want == r)) for r in set(want.tolist())}
    got = {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()}
    wrong = sum(got[i] != named[r] for i, r in zip(ids, want.tolist()))
    assert wrong <= 0.01 * len(rows)


def bridged(rng, each, words=300):
    """Two groups of close copies in which one pair across, not the closest by its bits, reaches 0.8; all others across stay below."""
    base = prose(rng, words).split()
    places = rng.sample(range(6, words - 6, 6), 7 + 2 * each)

    def edited(at, by):
        w = list(base)
        for k in at:
            w[k] = f"{by}{k}"
        return w

    far = edited(places[:7], "q")
    texts = [edited(places[:1], "q"), far]
    for k in range(each):
        texts.append(edited([places[7 + k]], "a"))
        texts.append([f"b{i}" if i == places[7 + each + k] else x for i, x in enumerate(far)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_one_pair_joins_two_groups(documents):
    rows = []
    for g in range(4):
        rows += [(1000 * g + i, t) for i, t in bridged(random.Random(g), 18)]
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    want = exact_classes(sets).tolist()
    assert len(set(want)) == 4
    got = {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()}
    assert [got[i] for i, _ in rows] == [rows[r][0] for r in want]


def test_repeats_within_a_text_do_not_count(documents):
    """A phrase said many times over neither makes unrelated texts alike nor similar ones different."""
    rng = random.Random(14)
    phrase = prose(rng, 7)
    rows = [(i, " ".join([phrase] * 60 + [prose(rng, 200)])) for i in range(6)]
    own = prose(rng, 200)
    rows += [(10, own + " " + phrase), (11, own + " " + " ".join([phrase] * 60))]
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    want = exact_classes(sets).tolist()
    assert want == [0, 1, 2, 3, 4, 5, 6, 6]
    got = {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()}
    assert [got[i] for i, _ in rows] == [rows[r][0] for r in want]


def test_equal_fingerprints_of_unlike_sets(documents, monkeypatch):
    monkeypatch.setattr("stratablock.llm.simhash.set_fingerprint", lambda hashes, lanes: bytes(8 * lanes) + set_fingerprint(hashes, lanes)[8 * lanes :])
    rows = [(i, prose(random.Random(i), 40)) for i in range(5)] + [(9, prose(random.Random(3), 40)), (8, ""), (7, None)]
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 9: 3, 8: 7, 7: 7}
    assert {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()} == want


def pair_at(rng, n):
    """Two texts of which exactly four in five of all shingles are shared: the worst case."""
    base = prose(rng, n).split()
    total = n - 4
    # one text of all words, and one that goes on for a quarter of its shingles more
    return " ".join(base), " ".join([*base, *prose(rng, total // 4).split()])


def test_recall_at_the_threshold(documents):
    """Of pairs at 0.8 exactly, short and long, nearly all are found."""
    rng = random.Random(21)
    rows = []
    for k in range(400):
        for c, text in enumerate(pair_at(rng, rng.choice([8, 12, 24, 44, 84, 204, 404]))):
            rows.append((2 * k + c, text))
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    at = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert min(at) >= 0.8 and np.mean(np.array(at) == 0.8) > 0.9
    got = {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()}
    assert np.mean([got[2 * k + 1] == 2 * k for k in range(400)]) >= 0.98


def test_families_of_one_template(documents):
    """Texts that share most of a template: all classes as by brute force, and no text in a wrong one."""
    rng = random.Random(33)
    rows = []
    for f in range(6):
        base = prose(rng, 120).split()
        for c in range(80):
            w = list(base)
            for k in rng.sample(range(120), rng.choice([1, 1, 2, 3])):
                w[k] = prose(rng, 1)
            rows.append((1000 * f + c, " ".join(w)))
    sets = [set(plain_shingles(t, 5)) for _, t in rows]
    want = exact_classes(sets).tolist()
    got = {r[0]: r[2] for r in near_duplicates(documents(rows)).collect()}
    mine = [got[i] for i, _ in rows]
    joined = [(a, b) for a in range(len(rows)) for b in range(a) if want[a] == want[b]]
    assert len(joined) > 300
    assert np.mean([mine[a] == mine[b] for a, b in joined]) >= 0.97
    assert all(want[a] == want[b] for a in range(len(rows)) for b in range(a) if mine[a] == mine[b])
