"""Document quality by a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over overlapping chunks that cover the whole
document (CHUNK positions each, so chunks share WIDTH - 1 bytes).  Each filter is
max-pooled in each chunk.  A second channel compares the chunk with itself at lags
1 to LAGS, which sees repetition whatever the words.  Means and maxima over all
chunks go through a small dense layer into one probability.

Training takes TRAIN_ROWS labelled rows at most, chosen by the hash of their id, and of
these, in that order, all whose whole texts fit in TRAIN_BYTES together (a text that
doesn't fit in what is left is passed over); both bounds are parameters.  A row that is
taken is learned from as a whole.  Scoring reads all bytes of all texts.  Weights are a
closure of about 70 KB.  Training is seeded: the same table gives the same scores.

A null text counts as empty; an empty text is one chunk of padding and gets a score
like any other.  Without labels of both kinds, all scores are the share of label 1
(or 0.5).  Rows that repeat an id are scored one by one; an id with several labels
counts with its smallest, one with several texts with that of the least hash.  A column
of the documents that is named as the score's is replaced; others are kept, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, read_table, text_of
from .pretoken import groups

CHUNK, WIDTH, FILTERS, LAGS, HIDDEN = 256, 5, 12, 40, 16
PAD = 256
TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 5000, 64 << 20, 8
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
_BLOCK = 512


def chunks_of(text: bytes) -> np.ndarray:
    """(chunks, CHUNK + WIDTH - 1) byte codes, PAD after the end."""
    n = max(1, -(-max(1, len(text) - WIDTH + 1) // CHUNK))
    flat = np.full(n * CHUNK + WIDTH - 1, PAD, np.int16)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK + WIDTH - 1)[::CHUNK]


def repetition(x: np.ndarray) -> np.ndarray:
    """Per chunk, the largest share of bytes equal to the byte ``lag`` before, over the lags that fit several times."""
    codes = np.ascontiguousarray(np.where(x[:, :CHUNK] == PAD, 0, x[:, :CHUNK]).astype(np.uint8))
    valid = (x[:, :CHUNK] != PAD).sum(1)
    best = np.zeros(len(x), np.float32)
    for lag in range(1, LAGS + 1):
        same = np.count_nonzero((codes[:, lag:] == codes[:, :-lag]) & (x[:, lag:CHUNK] != PAD), axis=1)
        share = same / np.maximum(valid - lag, 1)
        best = np.maximum(best, np.where(valid >= 2 * lag + 16, share, 0))
    return best.astype(np.float32)


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = {
            "w": rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "h": rng.normal(0, 0.3, (2 * FILTERS + 2, HIDDEN)).astype(np.float32),
            "c": np.zeros(HIDDEN, np.float32),
            "o": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "d": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def _respond(self, x: np.ndarray) -> np.ndarray:
        """(chunks, CHUNK, FILTERS)"""
        out = self.p["w"][0].take(x[:, :CHUNK], axis=0)
        for j in range(1, WIDTH):
            out += self.p["w"][j].take(x[:, j : j + CHUNK], axis=0)
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(chunks, FILTERS + 1): each filter's maximum in the chunk, and its repetition."""
        most = np.concatenate([self._respond(x[i : i + _BLOCK]).max(1) for i in range(0, len(x), _BLOCK)])
        return np.concatenate([np.maximum(most + self.p["b"], 0), repetition(x)[:, None]], axis=1)

    @staticmethod
    def _gathered(pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(starts, len(pooled)))[:, None]
        return np.concatenate([np.add.reduceat(pooled, starts) / n, np.maximum.reduceat(pooled, starts)], axis=1)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.p["h"] + self.p["c"], 0) @ self.p["o"] + self.p["d"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        parts = [chunks_of(t) for t in texts]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(int)
        z = self._gathered(self.pooled(np.concatenate(parts)), starts)
        return 1 / (1 + np.exp(-self._logits(z).astype(np.float64)))

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01, seed: int = 11) -> Network:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        rep = [repetition(d) for d in docs]
        step, steps = 0, epochs * -(-len(docs) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                step += 1
                at = order[i : i + batch]
                for k, g in self._gradients([docs[j] for j in at], [rep[j] for j in at], y[at]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    scale = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.p[k] -= (scale * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    def _gradients(self, docs: list[np.ndarray], rep: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, np.concatenate(docs)
        n = np.array([len(d) for d in docs])
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        arg = np.concatenate([self._respond(x[i : i + _BLOCK]).argmax(1) for i in range(0, len(x), _BLOCK)])  # (chunks, FILTERS)
        row = np.arange(len(x))[:, None]
        filt = np.arange(FILTERS)[None, :]
        raw = sum(p["w"][j][x[row, arg + j], filt] for j in range(WIDTH)) + p["b"]
        pooled = np.concatenate([np.maximum(raw, 0), np.concatenate(rep)[:, None]], axis=1)
        z = self._gathered(pooled, starts)
        a = z @ p["h"] + p["c"]
        r = np.maximum(a, 0)
        dl = ((1 / (1 + np.exp(-(r @ p["o"] + p["d"])))) - y) / len(y)
        da = dl[:, None] * p["o"] * (a > 0)
        dz = da @ p["h"].T
        doc = np.repeat(np.arange(len(docs)), n)
        k = FILTERS + 1
        dp = (dz[:, :k] / n[:, None])[doc] + dz[doc, k:] * (pooled == z[doc, k:])
        dr = (dp[:, :FILTERS] * (raw > 0)).astype(np.float32)
        dw = np.zeros_like(p["w"])
        for j in range(WIDTH):
            np.add.at(dw[j], (x[row, arg + j], np.broadcast_to(filt, arg.shape)), dr)
        return {"w": dw, "b": dr.sum(0), "h": z.T @ da, "c": da.sum(0), "o": r.T @ dl, "d": np.array([dl.sum()], np.float32)}


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", epochs: int = EPOCHS, most_bytes: int = TRAIN_BYTES) -> Network:
    """Learns from labelled rows outside the held-out fold; gathers ``rows`` ids and ``most_bytes`` bytes of text at most."""
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & (fold(F.col("_id")) != HELD_OUT))
    chosen = marked.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)

    # chosen has ``rows`` rows at most: a bound that doesn't grow with the data
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    one = texts.groupBy("_id").agg(F.min("_y").alias("_y"), F.min(F.struct(F.xxhash64("_text").alias("h"), F.encode("_text", "UTF-8").alias("t"))).alias("_of"))
    taken = cut(one.select(F.xxhash64("_id").alias("_order"), F.col("_id").cast("long").alias("_id"), "_y", F.col("_of.t").alias("_text")), "training-rows")
    left, places = most_bytes, []
    for r in taken.select("_order", "_id", F.octet_length("_text").alias("n")).orderBy("_order", "_id").collect():
        if r.n <= left:
            left -= r.n
            places.append(r["_id"])
    found = taken.filter(F.col("_id").isin(places)).collect() if places else []
    found.sort(key=lambda r: r["_id"])
    return Network().fit([chunks_of(bytes(r["_text"])) for r in found], np.array([r["_y"] for r in found], np.float32), epochs)


def scored(docs: DataFrame, model: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column after their own."""
    docs = docs.drop(score_col)
    place = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "_score"]
    plain = docs.toDF(*names[:-1])
    schema = StructType([*plain.schema.fields, StructField("_score", DoubleType())])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups(batches, place):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.scores(texts))], names)

    return plain.mapInArrow(score, schema).toDF(*docs.columns, score_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> DataFrame:
    """<id>, held_out, score, predicted per row."""
    model = train(docs, labels, rows=rows, id_col=id_col, text_col=text_col, epochs=epochs)
    out = scored(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return out.select(F.col("_id").alias(id_col), F.coalesce(fold(F.col("_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
