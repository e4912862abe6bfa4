"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read the UTF-8 bytes of a text, one from the left and one from the right,
in windows of WINDOW bytes, where their states begin anew; at every byte their states give a distribution over the languages. A
document's probabilities are the mean over all its bytes. The network is small enough to read
whole texts: matrices hold one column a window, thousands of windows to a numpy call.

Training is plain backpropagation through time in numpy on the driver, with Adam, over a bounded
sample of all languages: at most SAMPLE_DOCS different labelled documents a language (by a hash of id and text), of
which a stretch of STRETCH characters each is used, and SAMPLE_WINDOWS windows a language; where there
are so many languages that this would be over MOST_WINDOWS windows, all have fewer.

Defined cases: null text and text without a letter are `und` with score 0; every byte of long texts
is read in prediction; rows without a lang are no training rows; with no training row at all every prediction is
`und`; repeated rows get equal results and count once in training; a null doc_id is training data and not held out; ties go
to the language that is first by code point; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import crc_mod

HIDDEN, WINDOW, SEED = 8, 128, 5
SAMPLE_DOCS, SAMPLE_WINDOWS, MOST_WINDOWS, STRETCH = 600, 2000, 200_000, 8 * WINDOW
EPOCHS, BATCH, RATE = 4, 256, 0.02
#: Windows in one numpy call at most.
LANES = 2048

RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


class GatedReader:
    """One direction: columns are windows. gates holds update, reset and candidate rows for each byte."""

    def __init__(self, rng: np.random.Generator, hidden: int, labels: int):
        self.hidden = hidden
        self.gates = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
        self.inner = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
        self.bias = np.zeros((hidden, 1), np.float32)
        self.out = rng.normal(0, 0.3, (labels, hidden)).astype(np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.gates, self.inner, self.bias, self.out]

    def step(self, byte: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        h = self.hidden
        x = np.take(self.gates, byte, axis=1)
        a = self.inner @ state
        # A sigmoid is a shifted tanh.
        two = np.tanh((x[: 2 * h] + a[: 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
        update, reset = two[:h], two[h:]
        fed = a[2 * h :] + self.bias
        candidate = np.tanh(x[2 * h :] + reset * fed)
        return candidate + update * (state - candidate), update, reset, candidate, fed

    def read(self, bytes_: np.ndarray, active: np.ndarray, order: range, logits: np.ndarray) -> None:
        """Adds this direction's logits at every position; active[t] windows reach position t.

        What `step` does, in buffers that are used again at every position.
        """
        h, lanes = self.hidden, bytes_.shape[1]
        # A sigmoid is 1 / (1 + exp(-x)) and a hyperbolic tangent 2 / (1 + exp(-2x)) - 1: the factors go into the weights.
        factor = np.where(np.arange(3 * h) < 2 * h, -1, -2).astype(np.float32)[:, None]
        gates, inner, bias = self.gates * factor, self.inner * factor, self.bias * -2
        states, x_, a_, out_ = (np.zeros((k, lanes), np.float32) for k in (h, 3 * h, 3 * h, len(self.out)))
        for t in order:
            n = active[t]
            state, x, a, out = (m[:, :n] for m in (states, x_, a_, out_))
            if n < lanes:
                x, a, out = (np.empty((m.shape[0], n), np.float32) for m in (x, a, out))
            np.take(gates, bytes_[t, :n], axis=1, out=x, mode="clip")
            np.matmul(inner, state, out=a)
            two, fed, candidate = x[: 2 * h], a[2 * h :], x[2 * h :]
            two += a[: 2 * h]
            np.exp(two, out=two)
            two += 1
            np.reciprocal(two, out=two)
            fed += bias
            fed *= two[h:]
            candidate += fed
            np.exp(candidate, out=candidate)
            candidate += 1
            np.divide(2, candidate, out=candidate)
            candidate -= 1
            state -= candidate
            state *= two[:h]
            state += candidate
            np.matmul(self.out, state, out=out)
            logits[t, :, :n] += out

    def forward(self, bytes_: np.ndarray, order: range) -> list[tuple]:
        """States of whole windows in order, kept for backward."""
        state, kept = np.zeros((self.hidden, bytes_.shape[1]), np.float32), []
        for t in order:
            new, *parts = self.step(bytes_[t], state)
            kept.append((t, state, new, *parts))
            state = new
        return kept

    def backward(self, bytes_: np.ndarray, kept: list[tuple], error: np.ndarray) -> list[np.ndarray]:
        """Gradients of weights() from the error of the logits at every position."""
        h = self.hidden
        gates, inner, bias, out = (np.zeros_like(w) for w in self.weights())
        back = np.zeros_like(kept[0][1])
        for t, before, after, update, reset, candidate, fed in reversed(kept):
            out += error[t] @ after.T
            back = back + self.out.T @ error[t]
            d_candidate = back * (1 - update) * (1 - candidate**2)
            d_update = back * (before - candidate) * update * (1 - update)
            d_fed = d_candidate * reset
            d_reset = d_candidate * fed * reset * (1 - reset)
            inputs = np.concatenate([d_update, d_reset, d_candidate])
            recurrent = np.concatenate([d_update, d_reset, d_fed])
            for row in range(3 * h):
                gates[row] += np.bincount(bytes_[t], inputs[row], 256)
            inner += recurrent @ before.T
            bias += d_fed.sum(1, keepdims=True)
            back = back * update + self.inner.T @ recurrent
        return [gates, inner, bias, out]


class Network:
    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.right, self.left = GatedReader(rng, hidden, len(labels)), GatedReader(rng, hidden, len(labels))
        self.bias = np.zeros((len(labels), 1), np.float32)

    def weights(self) -> list[np.ndarray]:
        return [*self.right.weights(), *self.left.weights(), self.bias]

    def gradients(self, bytes_: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of the windows (columns of bytes_) and its gradients."""
        t, n = bytes_.shape
        right, left = self.right.forward(bytes_, range(t)), self.left.forward(bytes_, range(t - 1, -1, -1))
        logits = np.empty((t, len(self.labels), n), np.float32)
        for at, _, state, *_ in right:
            logits[at] = self.right.out @ state + self.bias
        for at, _, state, *_ in left:
            logits[at] += self.left.out @ state
        p = softmax(logits)
        loss = float(-np.log(p[:, label, np.arange(n)] + 1e-12).mean())
        p[:, label, np.arange(n)] -= 1
        p /= t * n
        return loss, [*self.right.backward(bytes_, right, p), *self.left.backward(bytes_, left, p), p.sum((0, 2))[:, None]]

    def train(self, windows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> list[float]:
        """Adam over shuffled batches; windows is one window a row. Returns the losses."""
        rng, losses = np.random.default_rng(seed), []
        weights = self.weights()
        mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        steps = max(1, epochs * -(-len(windows) // batch))
        for step in range(steps):
            pick = rng.choice(len(windows), min(batch, len(windows)), replace=False)
            loss, found = self.gradients(np.ascontiguousarray(windows[pick].T), label[pick])
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - step / steps) + 0.05)
            for w, g, m, s in zip(weights, found, mean, square, strict=True):
                g = np.clip(g, -1, 1)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                w -= (now * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-6)).astype(np.float32)
        return losses

    @np.errstate(over="ignore")  # exp may reach infinity; one over it is the zero that is meant
    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (a row a text): the mean over the text's positions; zeros for an empty text."""
        out = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + b" " * WINDOW, np.uint8)
        count = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(np.cumsum(sizes) - sizes, count) + nth * WINDOW
        length = np.minimum(WINDOW, np.repeat(sizes, count) - nth * WINDOW)
        longest_first = np.argsort(-length, kind="stable")
        for at in range(0, len(owner), LANES):
            lanes = longest_first[at : at + LANES]
            t = int(length[lanes[0]])
            bytes_ = data[start[lanes][None, :] + np.arange(t)[:, None]].astype(np.intp)
            active = (length[lanes][None, :] > np.arange(t)[:, None]).sum(1)
            logits = np.empty((t, len(self.labels), len(lanes)), np.float32)
            logits[:] = self.bias
            self.right.read(bytes_, active, range(t), logits)
            self.left.read(bytes_, active, range(t - 1, -1, -1), logits)
            p = softmax(logits)
            for k in np.flatnonzero(active < len(lanes)):
                p[k, :, active[k] :] = 0
            total = p.sum(0, dtype=np.float64)
            for label in range(len(self.labels)):
                out[:, label] += np.bincount(owner[lanes], total[label], len(texts))
        return out / np.maximum(sizes, 1)[:, None]


def softmax(logits: np.ndarray) -> np.ndarray:
    """Over the middle axis, in place."""
    if np.abs(logits).max(initial=0) > 60:  # beyond what single precision can sum as it is
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def fit(docs: DataFrame) -> Network | None:
    """A network from the rows of docs whose lang is known; None if there is none."""
    known = docs.where("lang is not null and text is not null and length(text) > 0")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    windows_each = max(1, min(SAMPLE_WINDOWS, MOST_WINDOWS // len(counts)))
    docs_each = max(1, min(SAMPLE_DOCS, windows_each))
    # Documents of a language are thinned by a hash to about as many as are wanted, so no sort of a whole language is needed.
    share = {r["lang"]: min(1.0, 1.3 * docs_each / r["count"]) for r in counts}
    rates = docs.sparkSession.createDataFrame(list(share.items()), "name string, share double")
    h = F.xxhash64("doc_id", "text")
    thinned = known.join(rates, F.col("lang") == F.col("name")).where(F.pmod(h, F.lit(1_000_000)) / 1_000_000 < F.col("share"))
    # A long text gives one stretch of it, from a place that its hash picks.
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - STRETCH, F.lit(1))).cast("int") + 1
    rows = thinned.select("lang", h.alias("h"), F.substring("text", place, F.lit(STRETCH)).alias("text")).dropDuplicates(["lang", "h"]).collect()
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows:
        texts.setdefault(r["lang"], []).append((r["h"], r["text"].encode()))
    labels = sorted(share)
    rng = np.random.default_rng(SEED)
    windows, label = [], []
    for k, lang in enumerate(labels):
        held = [t for _, t in sorted(texts.get(lang, []))[:docs_each]]
        cut = [t[i : i + WINDOW].ljust(WINDOW) for t in held for i in range(0, max(1, len(t) - WINDOW // 2), WINDOW)]
        for i in rng.permutation(len(cut))[:windows_each]:
            windows.append(np.frombuffer(cut[i], np.uint8)), label.append(k)
    network = Network(labels)
    if windows:
        network.train(np.stack(windows), np.array(label))
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = held.value
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]  # only those with a letter come with their text
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if network and network.labels:
                p = network.pooled(texts)
                for i, best in enumerate(p.argmax(1)):
                    if texts[i]:
                        names[i], scores[i] = network.labels[best], float(min(p[i, best], 1.0))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), lettered.alias("text"))
    return rows.mapInArrow(per_batch, RESULT)


def held_out():  # noqa: ANN201
    return crc_mod("doc_id", 4) == 2


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the documents that are not held out and labels all of them."""
    return identify(docs, fit(docs.where(~F.coalesce(held_out(), F.lit(False)))))
