import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from stratablock.llm.pretoken import UnitEncoder, cut_units
from stratablock.llm.token_counts import TokenTree, apply_edits, cleanup_edits, token_counts
from stratablock.llm.token_frames import ShardReader, ShardWriter, read_tokens, write_tokens
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    """Special tokens' strings are ordinary text."""
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def library():
    """The library as it is."""
    return Tokenizer.from_file(VOCABULARY)


def noise(rng, n):
    return "".join(rng.choice(" ab\n's1.\t é日 ") for _ in range(rng.randint(0, n)))


def test_units_give_the_ids_of_whole_texts(plain):
    rng = random.Random(1)
    texts = ["", " ", "  ", " a", "a  b\n c", "\n\n x  \n", "<|endoftext|> x", "a \x1c b", " x's it's", "wordwithoutspace" * 500]
    texts += [noise(rng, 60) for _ in range(2000)]
    enc = UnitEncoder(VOCABULARY, cache_units=50)
    for i in range(0, len(texts), 100):
        for got, want in zip(enc.encode(texts[i : i + 100]), plain.encode_batch(texts[i : i + 100], add_special_tokens=False)):
            assert np.frombuffer(got, enc.kind).tolist() == want.ids


def test_special_tokens_as_the_library_takes_them(library):
    rng = random.Random(4)
    enc = UnitEncoder(VOCABULARY, special_as_text=False)
    texts = ["<|endoftext|>", "a  <|endoftext|> b", "x <|endoftext|>\n<|endoftext|>", "<|endoftext", *("<|endoftext|>".join(noise(rng, 20) for _ in range(rng.randint(1, 4))) for _ in range(500))]
    for got, want in zip(enc.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, enc.kind).tolist() == want.ids
    assert len(np.frombuffer(enc.encode(["a <|endoftext|>"])[0], enc.kind)) < len(np.frombuffer(UnitEncoder(VOCABULARY).encode(["a <|endoftext|>"])[0], enc.kind))


def test_tree_follows_edits(plain):
    rng = random.Random(2)
    enc = UnitEncoder(VOCABULARY)
    for _ in range(60):
        text = noise(rng, 1500)
        tree = TokenTree(cut_units(text), enc)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 2, 5, 400]))
            new = rng.choice(["", " ", "a", "x y", " \n", "hello world " * rng.randint(0, 60)])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text
            assert tree.n_tokens == len(plain.encode(text, add_special_tokens=False).ids)


def test_edit_encodes_only_what_it_touches():
    text = "some words of a text " * 2000
    tree = TokenTree(cut_units(text), UnitEncoder(VOCABULARY))
    tree.edit(20_000, 20_003, "new")
    assert tree.reencoded < 1000 and tree.text() == text[:20_000] + "new" + text[20_003:]


def test_shard_round_trip_and_damage():
    out = io.BytesIO()
    w = ShardWriter(out, 2)
    docs = [(None, [5, 2]), (7, [2]), (8, list(range(70)))]
    for i, ids in docs:
        w.add(i, np.array(ids, "<u2").tobytes())
    w.close()
    raw = out.getvalue()
    r = ShardReader(io.BytesIO(raw), len(raw))
    assert [(r.doc_id(k), r.ids(k).tolist()) for k in range(len(r))] == docs
    assert [x.tolist() for x in r.all_ids(read_bytes=1)] == [ids for _, ids in docs]
    import zstandard

    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert stream == b"".join(np.array(ids, "<u2").tobytes() for _, ids in docs)
    bad = bytearray(raw)
    bad[int(r.places[1]) + 6] ^= 1
    broken = ShardReader(io.BytesIO(bytes(bad)), len(raw))
    assert broken.ids(0).tolist() == [5, 2]
    with pytest.raises(Exception):
        broken.ids(1)


ROWS = [(3, "b c"), (1, None), (2, ""), (None, "x"), (3, "b c"), (9, "Hello  world\n" * 300), (4, "日本 語 é"), (8, "one <|endoftext|> two")]


def test_token_frames(documents, library):
    got = [tuple(r) for r in read_tokens(write_tokens(documents(ROWS), VOCABULARY)).collect()]
    want, start = [], 0
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_a_repeated_id_is_spread(spark, documents):
    """A third of all rows being one row, and a third having null ids: more shards than distinct ids, in order all the same."""
    rows = [(7, "same text")] * 3000 + [(None, f"null {i}") for i in range(3000)] + [(100 + i, "x") for i in range(20)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay apart, as large ones do
    try:
        manifest = write_tokens(documents(rows, 8), VOCABULARY)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted((tuple(r) for r in read_tokens(manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 3000 + [7] * 3000 + list(range(100, 120))
    assert sum(r[2] for r in got[:-1]) == got[-1][1]
    assert manifest.count() > 2 and max(r.n_docs for r in manifest.collect()) < 3000


def test_cleanup_is_linear():
    """Long texts without spaces, of addresses, of numbers; and the same edits as by the plain patterns."""
    import re
    import time

    address, number = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+"), re.compile("[0-9]{5,}")

    def plain_edits(text):
        last = text.rfind("\n")
        end = last if last > 0 else len(text)
        found = [(m.start(), m.end(), "<address>") for m in address.finditer(text, 0, end)]
        found += [(m.start(), m.end(), "<number>") for m in number.finditer(text, 0, end) if not any(a < m.end() and m.start() < b for a, b, _ in found)]
        return sorted(found + ([(last, len(text), "")] if last > 0 else []), reverse=True)

    rng = random.Random(6)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "@", ".", " ", "\n", "12345", "b.c", "@d"]) for _ in range(rng.randint(0, 25)))
        assert cleanup_edits(text) == plain_edits(text), repr(text)
    for text in ("x" * 2_000_000, "x@" * 500_000, "a@b.c 123456 " * 100_000, "1" * 2_000_000 + "@"):
        began = time.perf_counter()
        cleanup_edits(text)
        assert time.perf_counter() - began < 5


def test_counts_of_long_unbroken_texts(documents):
    rows = [(1, "x" * 300_000), (2, "a@b.c" * 20_000), (3, " " * 300_000), (4, "é" * 100_000 + "\n")]
    got = {r.doc_id: r for r in token_counts(documents(rows), VOCABULARY).collect()}
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [300_000, 100_000, 300_000, 100_001]
    assert got[4].n_chars_edited == 100_000 and all(r.n_tokens > 0 for r in got.values())


def test_token_frames_empty(documents):
    assert read_tokens(write_tokens(documents([]), VOCABULARY)).count() == 0


def test_token_counts(documents, plain):
    rows = [*ROWS, (5, "mail me at a.b@c.de or 123456789\nlast line"), (6, "\nx"), (7, "12345 99999\n\n")]
    n = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    want = []
    for i, t in rows:
        t = t or ""
        edits = cleanup_edits(t)
        after = apply_edits(t, edits)
        want.append((i, len(t), n(t), len(edits), len(after), n(after)))
    got = [tuple(r)[:6] for r in token_counts(documents(rows), VOCABULARY).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert token_counts(documents([]), VOCABULARY).count() == 0
