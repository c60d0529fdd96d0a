"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled documents and labels every byte position; a document's
language is the one with the largest mean probability over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each language in the training sample (about; chosen by hash).
SAMPLE = 250
#: Units of each direction, bytes of a segment that is read at once, segments of a block.
UNITS, SEGMENT, BLOCK = 12, 256, 2048
#: Training: steps, batch, bytes of a crop, learning rate.
STEPS, BATCH, CROP, RATE = 260, 96, 96, 0.02
UNKNOWN = "und"


@dataclass
class Model:
    """Weights of both directions, stacked; classes in sorted order.

    embed[d, byte]: input part of the gates (update, reset, candidate);
    state[d]: hidden part; bias[d]: of the candidate's hidden part;
    out[d], out_bias: to the classes.
    """

    classes: list[str]
    embed: np.ndarray
    state: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.state, self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fresh_model(classes: list[str], units: int = UNITS, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Model(
        classes,
        f(2, 256, 3 * units, scale=0.3),
        f(2, units, 3 * units, scale=units**-0.5),
        np.zeros((2, 1, units), np.float32),
        f(2, units, len(classes), scale=units**-0.5),
        np.zeros(len(classes), np.float32),
    )


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of x (batch, time) with classes y (batch), and its gradient by every weight."""
    n, steps = x.shape
    units = model.state.shape[1]
    both = np.stack([x, x[:, ::-1]])  # direction, batch, time
    h = np.zeros((2, n, units), np.float32)
    trace, hidden = [], np.empty((2, steps, n, units), np.float32)
    for t in range(steps):
        gate = np.stack([model.embed[d][both[d, :, t]] for d in range(2)])
        inner = h @ model.state
        z = _sigmoid(gate[..., :units] + inner[..., :units])
        r = _sigmoid(gate[..., units : 2 * units] + inner[..., units : 2 * units])
        part = inner[..., 2 * units :] + model.bias
        c = np.tanh(gate[..., 2 * units :] + r * part)
        trace.append((h, z, r, part, c))
        h = (1 - z) * c + z * h
        hidden[:, t] = h
    aligned = np.stack([hidden[0], hidden[1, ::-1]])  # both at the same position
    prob = _softmax(aligned[0] @ model.out[0] + aligned[1] @ model.out[1] + model.out_bias)
    loss = float(-np.log(prob[:, np.arange(n), y] + 1e-9).mean())
    delta = prob
    delta[:, np.arange(n), y] -= 1
    delta /= n * steps
    d_out = np.stack([np.einsum("tnu,tnc->uc", aligned[d], delta) for d in range(2)])
    back = np.stack([delta @ model.out[0].T, (delta @ model.out[1].T)[::-1]])
    d_embed, d_state, d_bias = np.zeros_like(model.embed), np.zeros_like(model.state), np.zeros_like(model.bias)
    d_h = np.zeros((2, n, units), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, part, c = trace[t]
        d_h = d_h + back[:, t]
        d_c = d_h * (1 - z) * (1 - c * c)
        d_z = d_h * (before - c) * z * (1 - z)
        d_r = d_c * part * r * (1 - r)
        d_part = d_c * r
        d_inner = np.concatenate([d_z, d_r, d_part], axis=-1)
        d_gate = np.concatenate([d_z, d_r, d_c], axis=-1)
        for d in range(2):
            np.add.at(d_embed[d], both[d, :, t], d_gate[d])
        d_state += before.transpose(0, 2, 1) @ d_inner
        d_bias += d_part.sum(axis=1, keepdims=True)
        d_h = d_h * z + d_inner @ model.state.transpose(0, 2, 1)
    return loss, [d_embed, d_state, d_bias, d_out, delta.sum(axis=(0, 1))]


def train(texts: list[bytes], labels: list[str], units: int = UNITS, steps: int = STEPS, seed: int = 5) -> Model:
    """Fits a model with Adam on random crops, languages in equal shares."""
    classes = sorted(set(labels))
    model = fresh_model(classes, units, seed)
    if len(classes) < 2:
        return model
    rng = np.random.default_rng(seed)
    data = [np.frombuffer(t, np.uint8) for t in texts]
    by_class = [[i for i, v in enumerate(labels) if v == c] for c in classes]
    first = [np.zeros_like(w) for w in model.weights()]
    second = [np.zeros_like(w) for w in model.weights()]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(classes), BATCH)
        x = np.full((BATCH, CROP), 32, np.uint8)
        for row, k in enumerate(y):
            t = data[by_class[k][rng.integers(len(by_class[k]))]]
            at = rng.integers(0, max(1, len(t) - CROP + 1))
            part = t[at : at + CROP]
            x[row, : len(part)] = part
        _, grads = gradients(model, x, y)
        norm = max(1.0, float(np.sqrt(sum((g * g).sum() for g in grads))))
        rate = RATE * min(1.0, 2 * (steps - step + 1) / steps)
        for w, g, a, b in zip(model.weights(), grads, first, second, strict=True):
            g = g / norm
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def label_positions(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class probabilities (time, segment, class) of every position of padded segments x (segment, time); 0 in the padding."""
    n, steps = x.shape
    units = model.state.shape[1]
    h = np.zeros((2, n, units), np.float32)
    logits = np.zeros((steps, n, len(model.classes)), np.float32)
    gate = np.empty((2, n, 3 * units), np.float32)
    columns = np.ascontiguousarray(x.T)
    shortest = int(lengths.min())
    for t in range(steps):
        back = steps - 1 - t
        np.take(model.embed[0], columns[t], axis=0, out=gate[0])
        np.take(model.embed[1], columns[back], axis=0, out=gate[1])
        inner = h @ model.state
        zr = _sigmoid(gate[..., : 2 * units] + inner[..., : 2 * units])
        z, r = zr[..., :units], zr[..., units:]
        c = np.tanh(gate[..., 2 * units :] + r * (inner[..., 2 * units :] + model.bias))
        h = c + z * (h - c)
        if back >= shortest:  # the backward direction starts at each segment's own end
            h[1][lengths <= back] = 0
        logits[t] += h[0] @ model.out[0]
        logits[back] += h[1] @ model.out[1]
    prob = _softmax(logits + model.out_bias)
    prob[np.arange(steps)[:, None] >= lengths[None, :]] = 0
    return prob


def pool(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(mean class probabilities of each text's positions, its number of positions). Whole texts, cut into segments."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + place * SEGMENT
    lengths = np.minimum(SEGMENT, sizes[owner] - place * SEGMENT)
    stream = np.frombuffer(b"".join(texts) + bytes(SEGMENT), np.uint8)
    total = np.zeros((len(texts), len(model.classes)))
    order = np.argsort(lengths, kind="stable")
    for i in range(0, len(order), BLOCK):
        part = order[i : i + BLOCK]
        x = stream[starts[part][:, None] + np.arange(int(lengths[part].max()))]
        prob = label_positions(model, x, lengths[part])
        np.add.at(total, owner[part], prob.sum(axis=0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None], sizes


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus)) == remainder


def training_sample(docs: DataFrame, per_class: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """About ``per_class`` labelled documents of each language, by hash of doc_id; never over twice as many."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    if not sizes:
        return [], []
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, per_class / n))])
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(77)), 11) / F.lit(float(1 << 53))
    rows = usable.filter(unit < F.element_at(share, F.col("lang"))).orderBy(F.xxhash64("doc_id", F.lit(78)), "doc_id").limit(2 * per_class * len(sizes)).collect()
    return [r["text"].encode() for r in rows], [r["lang"] for r in rows]


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_positions.

    ``und`` with score 0 where the text is null or has no letter, or where no
    language was learned; with one language learned, it is that one. Only the
    text decides. Repeated rows are predicted alike, an empty table gives an
    empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            texts = [t.encode() if t is not None else b"" for t in batch.column(2).to_pylist()]
            if net.classes and texts:
                mean, sizes = pool(net, texts)
                best = mean.argmax(axis=1)
                names = [net.classes[k] if n else UNKNOWN for k, n in zip(best, sizes, strict=True)]
                scores = np.clip(mean[np.arange(len(texts)), best], 0.0, 1.0)
            else:
                names, scores, sizes = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(sizes)], names=["doc_id", "held_out", "lang_pred", "score", "n_positions"])

    letters = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), letters.alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, n_positions long"
    )


def identify(docs: DataFrame, per_class: int = SAMPLE, units: int = UNITS, steps: int = STEPS) -> DataFrame:
    """Trains on the sample of ``docs`` and predicts all of it (see ``predict``)."""
    texts, labels = training_sample(docs, per_class)
    return predict(docs, train(texts, labels, units, steps))
