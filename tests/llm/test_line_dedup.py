import random

import numpy as np
from stratablock.llm.line_dedup import extensions, line_dedup, positions, real_lines, windows, without


def plain(rows, min_words):
    """Deleted real lines of each row: those of a run of min_words words that occurs earlier."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, gone = set(), [set() for _ in rows]
    for k in order:
        lines = real_lines(rows[k][1] or "")[0]
        mine = []
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a : b + 1]) >= min_words:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        gone[k].update(range(a, b + 1))
                    mine.append(run)
                    seen.add(run)
    return gone


def corpus(rng):
    pool = [" ".join(rng.choice("abcdefg") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))) for _ in range(14)]
    rows = []
    for i in range(25):
        lines = [rng.choice(pool) if rng.random() < 0.8 else f"own{i} {rng.random()}" for _ in range(rng.randint(0, 12))]
        lines = [x if rng.random() < 0.9 else f"  {x} \n \t" for x in lines]
        rows.append((rng.randint(0, 10_000) * 2 + i % 2, "\n".join(lines)))
    ids = set()
    return [(i, t) for i, t in rows if not (i in ids or ids.add(i))]


def test_against_brute_force(documents):
    """However many classes of a line are compared in one task, and however many are split by their windows."""
    rng = random.Random(8)
    for min_words, hot in ((1, 256), (6, 256), (6, 1), (12, 256), (12, 3)):
        rows = corpus(rng)
        got = {r.doc_id: (r.n, r.text) for r in line_dedup(documents(rows), min_words=min_words, count_col="n", hot_classes=hot).collect()}
        for (i, t), gone in zip(rows, plain(rows, min_words)):
            assert got[i] == (len(gone), without(t, [(k, k) for k in gone])[0] if gone else t), (min_words, hot, i)


def test_a_run_whose_first_occurrence_is_shorter(documents):
    """Of a passage that goes on in the second and the third document, the third loses all of it."""
    head, tail = "a head of five words\nthat is long enough", "a tail too short\nalone"
    rows = [(1, f"x\n{head}\ny"), (2, f"z\n{head}\n{tail}"), (3, f"{head}\n{tail}\nend"), (4, f"{tail}\nlast")]
    got = {r.doc_id: r.text for r in line_dedup(documents(rows), min_words=8).collect()}
    assert got == {1: rows[0][1], 2: f"z\n{tail}", 3: "end", 4: rows[3][1]}


def test_cases(documents):
    passage = "\n".join(f"line {k} of a passage that is long enough" for k in range(5))
    rows = [(None, passage), (1, f"own\n{passage}\n\nend"), (2, None), (3, ""), (4, "short line"), (5, "short line"), (6, passage + "\n" + passage), (6, passage + "\n" + passage)]
    out = line_dedup(documents(rows), count_col="n_deleted")
    assert out.columns == [*documents([]).columns, "n_deleted"]
    got = sorted(((r.doc_id, r.text, r.n_deleted, r._text) for r in out.collect()), key=str)
    want = [(None, passage, 0), (1, "own\nend", 5), (2, None, 0), (3, "", 0), (4, "short line", 0), (5, "short line", 0), (6, "", 10), (6, "", 10)]
    assert got == sorted(((*w, "x") for w in want), key=str)
    assert line_dedup(documents([])).count() == 0


def test_windows_are_bounded():
    assert max(b - a for a, b in windows(np.ones(5000, int), 30)) == 29
    assert windows(np.zeros(0, int), 30) == []
    assert positions(real_lines("\n" * 100_000 + "a b c")[0], 30) == []


def test_positions_are_sparse_and_shared():
    """Fewer positions than lines and windows; equal runs that are long enough share one at the same place, whatever surrounds them."""
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(2, 6)))
    for _ in range(50):
        run = [line() for _ in range(rng.randint(10, 20))]
        texts = [[line() for _ in range(rng.randint(20, 40))] + run + [line() for _ in range(rng.randint(20, 40))] for _ in range(2)]
        found = [{(p - t.index(run[0]), key) for key, _, p, _, _ in positions(t, 30) if t.index(run[0]) <= p < t.index(run[0]) + len(run)} for t in texts]
        assert found[0] & found[1]
        for t in texts:
            words = np.array([len(x.split()) for x in t])
            assert len(positions(t, 30)) < 0.6 * len(t) and len(positions(t, 30)) < 0.6 * len(windows(words, 30))


def test_selection_and_extension_decide(documents, monkeypatch):
    """Without selected lines nothing is joined; without extension no match is found between different surroundings."""
    import stratablock.llm.line_dedup as L

    run = [f"a line of the run {k}" for k in range(6)]
    texts = [["one", *run, "two"], ["three", *run, "four"]]
    found = [positions(t, 12) for t in texts]
    shared = {f[0] for f in found[0]} & {f[0] for f in found[1]}
    assert shared and {f[1] for f in found[0]} != {f[1] for f in found[1]}
    spans = set()
    for key in shared:
        rows = [next(f for f in one if f[0] == key) for one in found]
        for row, a, b in extensions([np.frombuffer(r[4], L._LINE) for r in rows], [r[3] for r in rows], 12):
            spans.update(range(rows[row][2] - a, rows[row][2] + b + 1))
    assert spans == set(range(1, 7))
    monkeypatch.setattr(L, "selected", lambda hashes, spans: {})
    assert positions(texts[0], 12) == []
