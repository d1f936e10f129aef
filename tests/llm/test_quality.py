import math
import random
import zlib

import numpy as np
from stratablock.llm.quality import CHUNK, FILTERS, HIDDEN, LAGS, WIDTH, Network, chunks_of, quality, repetition, scored, train


def corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        kind = i % 4
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3:
            words = [w for w in words[:8] for _ in range(30)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind % 2 == 0), 0))
    return rows, labels


def test_chunks_cover_all_bytes():
    for n in (0, 1, WIDTH, CHUNK, CHUNK + WIDTH - 1, CHUNK + WIDTH, 5 * CHUNK + 17):
        x = chunks_of(bytes(range(256)) * 9 if n > 2304 else (bytes(range(256)) * 9)[:n])
        text = (bytes(range(256)) * 9)[:n]
        positions = {(i * CHUNK + j) for i in range(len(x)) for j in range(CHUNK + WIDTH - 1) if x[i, j] != 256}
        assert positions >= set(range(len(text)))
        assert all(x[i, j] == text[i * CHUNK + j] for i in range(len(x)) for j in range(CHUNK + WIDTH - 1) if i * CHUNK + j < len(text))


def test_repetition_channel():
    assert repetition(chunks_of(b"abcdefg " * 40))[0] > 0.95
    assert repetition(chunks_of(bytes(np.random.default_rng(0).integers(97, 123, 300).astype(np.uint8))))[0] < 0.3


def test_gradients():
    rng = np.random.default_rng(1)
    docs = [chunks_of(bytes(rng.integers(97, 110, n).astype(np.uint8))) for n in (40, 700, 300)]
    y = np.array([1, 0, 1], np.float32)
    net = Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rep = [repetition(d) for d in docs]

    def loss():
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])[:-1]])
        s = net._logits(net._gathered(net.pooled(np.concatenate(docs)), starts))
        return float(np.mean(np.log1p(np.exp(s)) - y * s))

    grads = net._gradients(docs, rep, y)
    learned = np.argwhere(np.abs(grads["w"]) > 1e-4)
    assert len(learned) > 20
    places = [(k, (0,) * net.p[k].ndim) for k in ("b", "h", "o", "d", "c")] + [("w", tuple(at)) for at in learned[:: len(learned) // 12]]
    for k, at in places:
        net.p[k][at] += 1e-6
        up = loss()
        net.p[k][at] -= 2e-6
        down = loss()
        net.p[k][at] += 1e-6
        assert abs((up - down) / 2e-6 - grads[k][at]) < 1e-3, (k, at)
    assert not grads["w"][:, :97].any()


def plain_score(net, text):
    """The forward pass stated again, byte by byte."""
    n = max(1, -(-max(1, len(text) - WIDTH + 1) // CHUNK))
    code = lambda i: text[i] if i < len(text) else 256
    rows = []
    for c in range(n):
        begin = c * CHUNK
        row = []
        for f in range(FILTERS):
            best = max(sum(float(net.p["w"][j, code(begin + i + j), f]) for j in range(WIDTH)) for i in range(CHUNK))
            row.append(max(best + float(net.p["b"][f]), 0))
        held = min(max(len(text) - begin, 0), CHUNK)
        shares = [0.0]
        for lag in range(1, LAGS + 1):
            if held >= 2 * lag + 16:
                shares.append(sum(text[begin + i] == text[begin + i - lag] for i in range(lag, held)) / (held - lag))
        rows.append([*row, max(shares)])
    z = [sum(r[k] for r in rows) / n for k in range(FILTERS + 1)] + [max(r[k] for r in rows) for k in range(FILTERS + 1)]
    hidden = [max(sum(z[i] * float(net.p["h"][i, u]) for i in range(len(z))) + float(net.p["c"][u]), 0) for u in range(HIDDEN)]
    return 1 / (1 + math.exp(-(sum(h * float(o) for h, o in zip(hidden, net.p["o"])) + float(net.p["d"][0]))))


def test_scores_against_a_plain_forward_pass():
    rng = random.Random(2)
    net = Network()
    texts = [b"", b"a", b"abcde", bytes(rng.randrange(256) for _ in range(700)), b"the same again " * 40, bytes(rng.choice(b"ab \n") for _ in range(CHUNK + WIDTH - 1))]
    for got, text in zip(net.scores(texts), texts):
        assert abs(got - plain_score(net, text)) < 1e-5


def test_training_reads_whole_texts_and_the_same_rows(spark, documents):
    """Every chunk of a chosen row counts, rows that don't fit are passed over, and repeated ids don't make it a matter of chance."""
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    rows = [(i, ("good words " if i % 2 else "BAD!! ") * (40 + i)) for i in range(40)]
    end = [(i, t + " and an end of it that only a whole text has " * (i == 3)) for i, t in rows]
    weights = lambda r, **k: np.concatenate([v.ravel() for v in train(documents(r), labels, epochs=1, **k).p.values()])
    assert not np.array_equal(weights(rows), weights(end))
    double = rows + [(i, "another text " + t) for i, t in rows[:10]]
    random.Random(1).shuffle(double)
    assert np.array_equal(weights(double), weights(sorted(double, reverse=True)))
    long = [(i, "x" * 50_000 if i == 3 else t) for i, t in rows]
    longer = [(i, "y" * 60_000 if i == 3 else t) for i, t in rows]
    assert np.array_equal(weights(long, most_bytes=40_000), weights(longer, most_bytes=40_000))


def test_score_column_is_replaced(documents):
    out = scored(documents([(1, "a"), (2, None)]).selectExpr("*", "5 AS Score", "6 AS c0", "7 AS `x.y`"), Network())
    assert out.columns == [*documents([]).columns, "c0", "x.y", "score"]
    assert all(0 < r.score < 1 and r.c0 == 6 and r["x.y"] == 7 for r in out.collect())


def test_repeated_ids(spark, documents):
    rows, labels = corpus(80)
    double = [*rows, *rows[:20], (3, "another text of that id")]
    out = quality(documents(double), spark.createDataFrame([*labels, (3, 1, 0)], "doc_id long, quality int, toxic int"), epochs=1).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in double)
    by_text = {}
    for r in out:
        by_text.setdefault(r.doc_id, set()).add(round(r.score, 5))  # sums differ in their last digits by batch
    assert all(len(s) == (2 if i == 3 else 1) for i, s in by_text.items())


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus(400)
    docs = documents([*rows, (None, None), (5000, ""), (5001, "x" * 300_000)])
    out = quality(docs, spark.createDataFrame([*labels, (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + 3
    truth = {i: q for i, q, _ in labels}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality(documents([(1, "a"), (2, "b")]), none).collect()] == [0.5, 0.5]
    assert quality(documents([]), none).count() == 0
