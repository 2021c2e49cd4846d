"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded: shares of character
classes, word shapes and repetition, and a signed hash projection of its words. A
hidden layer, gated attention and a logistic output are learned from document labels
alone: the attention weighs the passages, the weighted sum is scored.

The model is trained in the driver on the passages of a bounded, seeded sample of
labelled documents (``SAMPLE``); labels, language, source and ids are never inputs of
a score. Rows whose crc32(id as text) mod 3 is 1 are held out: their labels are not
read for training.

Scale: scoring is one Arrow map over whole texts; the weights (a few thousand numbers)
travel with the task. The sample's ids reach the documents by a broadcast of at most
SAMPLE rows.

A null or empty text is one empty passage and has a score. Without usable labels of
both kinds every score is 0.5. Labels other than 0 and 1 and ids with conflicting
labels are not learned from. Repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a passage.
PASSAGE = 96
#: Labelled documents that are learned from, at most.
SAMPLE = 6_000
#: Passages of a labelled document that are learned from, at most, evenly spread; scores
#: read all passages.
LEARNED = 256
#: Signed hash features of a passage's words.
HASHED = 32
#: Character classes by byte: upper, lower, digit, blank-free ASCII marks by kind,
#: and bytes of other characters.
MARKS = (b".,;:'\"-()", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~")
SHAPES = 7
#: Features of a passage.
WIDTH = 3 + 2 * SHAPES + 5 + HASHED
SEED = 17
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
#: Words whose features are gathered at once.
GATHERED = 1 << 17


def _byte_classes() -> np.ndarray:
    table = np.zeros((256, SHAPES), np.float32)
    for c in range(256):
        if 65 <= c <= 90:
            table[c, 0] = 1
        elif 97 <= c <= 122:
            table[c, 1] = 1
        elif 48 <= c <= 57:
            table[c, 2] = 1
        elif c >= 128:
            table[c, 3] = 1
        else:
            for i, marks in enumerate(MARKS):
                table[c, 4 + i] = float(bytes([c]) in [bytes([m]) for m in marks])
    return table


BYTE_CLASSES = _byte_classes()


def _word_table(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word: its hash, and length, class shares, whole-word flags
    and signed hash features."""
    import xxhash

    raw = [w.encode() for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    counts = np.zeros((len(raw), SHAPES), np.float32)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        counts[full] = np.add.reduceat(BYTE_CLASSES[np.frombuffer(b"".join(raw), np.uint8)], starts, axis=0)
    shares = counts / np.maximum(sizes, 1)[:, None]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in raw), np.uint64, len(raw))
    lower = np.fromiter((xxhash.xxh32_intdigest(w.lower()) for w in words), np.uint32, len(words))
    signs = ((lower[:, None] >> np.arange(HASHED, dtype=np.uint32)) & 1).astype(np.float32) * 2 - 1
    head = np.stack([np.ones(len(raw), np.float32), np.minimum(sizes, 40) / 10, (sizes > 24).astype(np.float32)], axis=1)
    return hashes, np.concatenate([head[:, 1:], shares, (shares >= 0.999).astype(np.float32), signs], axis=1)


def encode(texts: pa.Array, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Passages per text (one at least), and a feature row for each passage."""
    lengths, index, words = common.split_words(texts)
    passages = np.maximum(-(-lengths // passage), 1)
    out = np.zeros((int(passages.sum()), WIDTH), np.float32)
    if not len(index):
        return passages, out
    # Words of a text are dealt out evenly over its passages.
    first = np.cumsum(passages) - passages
    place = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.repeat(first, lengths) + place * np.repeat(passages, lengths) // np.repeat(lengths, lengths)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    rows, n = at[starts], np.diff(np.concatenate([starts, [len(at)]])).astype(np.float32)
    hashes, table = _word_table(words)
    sums = np.empty((len(starts), table.shape[1]), np.float32)
    done, stops = 0, np.concatenate([starts[1:], [len(index)]])
    while done < len(starts):
        to = max(done + 1, int(np.searchsorted(stops, starts[done] + GATHERED, side="right")))
        sums[done:to] = np.add.reduceat(table[index[starts[done] : stops[to - 1]]], starts[done:to] - starts[done], axis=0)
        done = to
    shapes = 2 + 2 * SHAPES
    own = hashes[index]
    again = [np.concatenate([np.zeros(k, bool), (own[k:] == own[:-k]) & (at[k:] == at[:-k])]).astype(np.float32) for k in (1, 2, 3)]
    order = np.lexsort((own, at))
    fresh = np.concatenate([[True], (own[order][1:] != own[order][:-1]) | (at[order][1:] != at[order][:-1])])
    distinct = np.bincount(at[order][fresh], minlength=len(out))[rows]
    out[rows, 0] = 1
    out[rows, 1 : 1 + shapes] = sums[:, :shapes] / n[:, None]
    out[rows, 1 + shapes : 4 + shapes] = np.stack([np.add.reduceat(a, starts) for a in again], axis=1) / n[:, None]
    out[rows, 4 + shapes] = distinct / n
    out[rows, 5 + shapes] = np.log1p(n) / 5
    out[rows, WIDTH - HASHED :] = sums[:, shapes:] / np.sqrt(n)[:, None] / 4
    return passages, out


@dataclass
class Model:
    """Hidden layer, gated attention (v, u, w) and logistic output (c, b)."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """Scores of documents whose passages are the rows of ``x`` in order."""
        return _forward(self.p, (x - self.mean) / self.scale, np.cumsum(passages) - passages, passages)["score"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    h = np.tanh(x @ p["W"] + p["a"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
    att = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(att[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "att": att, "z": z, "score": _sigmoid(z @ p["c"] + p["b"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes of the mean cross-entropy of document labels."""
    f = _forward(p, x, starts, sizes)
    dz_out = (f["score"] - labels) / len(labels)
    grad = {"c": f["z"].T @ dz_out, "b": np.array([dz_out.sum()])}
    dz = np.repeat(dz_out[:, None] * p["c"], sizes, axis=0)
    datt = (dz * f["h"]).sum(axis=1)
    de = f["att"] * (datt - np.repeat(np.add.reduceat(f["att"] * datt, starts), sizes))
    grad["w"] = (f["t"] * f["g"]).T @ de
    dt = de[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
    grad["v"], grad["u"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (dz * f["att"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
    grad["W"], grad["a"] = x.T @ dh, dh.sum(axis=0)
    return grad


def train(x: np.ndarray, passages: np.ndarray, labels: np.ndarray, hidden: int = 24, gate: int = 12, rounds: int = 100, rate: float = 0.03, decay: float = 1e-4, seed: int = SEED) -> Model:
    """Adam on the cross-entropy of document labels, all bags in every step."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - mean) / scale
    starts = np.cumsum(passages) - passages
    rng = np.random.default_rng(seed)
    shape = {"W": (x.shape[1], hidden), "a": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "w": (gate,), "c": (hidden,), "b": (1,)}
    p = {k: (rng.normal(0, s[0] ** -0.5, s) if k not in "ab" else np.zeros(s)) for k, s in shape.items()}
    m, v = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        grad = gradients(p, x, starts, passages, labels)
        for k, d in grad.items():
            d = d + decay * p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, p)


def held_out(key: str) -> F.Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """Learns from at most ``sample`` labelled documents; None without both labels."""
    clean = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2")
    clean = common.materialize(clean.select("id", F.col("y").cast("double").alias("y")), "labels")
    picked = common.materialize(common.seeded_sample(clean, "id", sample, seed), "labelled")
    own = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "id")  # at most ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.slices(b, 0, max_bytes=SLICE):
                n, x = encode(part.column(0))
                if (n > LEARNED).any():
                    picked = np.concatenate([e - k + (np.unique(np.linspace(0, k - 1, LEARNED).astype(int)) if k > LEARNED else np.arange(k)) for e, k in zip(np.cumsum(n), n, strict=True)])
                    n, x = np.minimum(n, LEARNED), x[picked]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(n), pa.array([x[e - k : e].tobytes() for e, k in zip(np.cumsum(n), n, strict=True)], pa.binary())], names=["id", "y", "n", "x"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType), T.StructField("y", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("x", T.BinaryType())])
    common.bound_batches(docs.sparkSession)
    found = own.select("t", "id", "y").mapInArrow(lambda it: common.released(run(it)), schema).toPandas()
    found = found.sort_values(["id", "n"], ignore_index=True)
    if found["y"].nunique() < 2:
        return None
    x = np.concatenate([np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in found["x"]]).astype(np.float64)
    return train(x, found["n"].to_numpy(), found["y"].to_numpy(), seed=seed)


def score(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score and predicted for every row."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.slices(b, 2, max_bytes=SLICE):
                if model is None:
                    scores = np.full(part.num_rows, 0.5)
                else:
                    n, x = encode(part.column(2))
                    scores = np.round(model.bags(x.astype(np.float64), n), 6)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64())], names=schema.names)

    common.bound_batches(df.sparkSession)
    return df.select(F.col(key), held_out(key).alias("held_out"), F.col(text).cast("string")).mapInArrow(lambda it: common.released(run(it)), schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator: learns from ``labels`` and scores every document."""
    return score(docs, fit(docs, labels, key, text), key, text)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the documents that the classifier rejects, same columns.

    The verdict is made in the same pass as the rows, so nothing is joined."""
    model = fit(docs, labels, key, text)
    if model is None:
        return docs
    at = docs.columns.index(text)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of theirs can clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in common.slices(b, at, max_bytes=SLICE):
                n, x = encode(part.column(at))
                yield part.filter(pa.array(np.round(model.bags(x.astype(np.float64), n), 6) >= 0.5))

    rows = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    kept = rows.mapInArrow(lambda it: common.released(run(it)), rows.schema)
    return kept.select(*(F.col(n).cast(f.dataType).alias(f.name) for n, f in zip(names, docs.schema, strict=True)))
