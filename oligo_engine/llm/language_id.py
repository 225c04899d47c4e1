"""Language identification with a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; a gated recurrent unit reads each window
forwards, another backwards, and a softmax over both states labels every byte. The mean
of the byte probabilities is the document's. The network is trained in numpy by
backpropagation through time with Adam, on a bounded sample: at most ``per_language``
documents of each language, those with the smallest hashes of their ids, at most
``sample_chars`` characters of each. Prediction reads every byte of every text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without
any labelled text all are; rows with a null language teach nothing; ids may be null or
repeat; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from oligo_engine.llm.common import map_arrow, slabs
from oligo_engine.llm.toxic_text import is_held_out

WINDOW, HIDDEN = 64, 8
#: Bytes per step of the recurrence: small enough for the processor's cache.
SLAB = WINDOW << 12


def new_network(languages: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    """Weights by name; ``x`` holds a column of inputs per byte value."""
    source = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (source.standard_normal(shape) * scale).astype(np.float32)

    net = {"out": normal(languages, 2 * hidden, scale=0.3), "bias": np.zeros((languages, 1), np.float32)}
    for way in "fb":
        net[f"x{way}"] = normal(3 * hidden, 256, scale=0.5)
        net[f"u{way}"] = normal(3 * hidden, hidden, scale=1 / np.sqrt(hidden))
    return net


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def gates(x: np.ndarray, h: np.ndarray, u: np.ndarray, hidden: int):
    """(update, reset, recurrent part of the candidate, candidate)."""
    ru = u @ h
    zr = sigmoid(x[: 2 * hidden] + ru[: 2 * hidden])
    part = ru[2 * hidden :]
    return zr[:hidden], zr[hidden:], part, np.tanh(x[2 * hidden :] + zr[hidden:] * part)


def states(net: dict, windows: np.ndarray, way: str) -> np.ndarray:
    """States (time, hidden, windows) after reading each byte in the given direction."""
    u = net[f"u{way}"]
    hidden, (n, length) = u.shape[1], windows.shape
    out = np.empty((length, hidden, n), np.float32)
    h = np.zeros((hidden, n), np.float32)
    for t in range(length) if way == "f" else range(length - 1, -1, -1):
        z, _, _, c = gates(np.take(net[f"x{way}"], windows[:, t], axis=1), h, u, hidden)
        h = h + z * (c - h)
        out[t] = h
    return out


def position_probabilities(net: dict, windows: np.ndarray) -> np.ndarray:
    """Label probabilities (time, languages, windows) of every byte."""
    forward, backward = states(net, windows, "f"), states(net, windows, "b")
    hidden = forward.shape[1]
    logits = np.matmul(net["out"][:, :hidden], forward) + np.matmul(net["out"][:, hidden:], backward) + net["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def gradients(net: dict, windows: np.ndarray, real: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """(mean cross-entropy over real bytes, its gradients), through time in both directions."""
    hidden = net["uf"].shape[1]
    both = {way: states(net, windows, way) for way in "fb"}
    p = position_probabilities(net, windows)
    n, length = windows.shape
    weight = (real.T / real.sum())[:, None, :].astype(np.float32)  # (time, 1, windows)
    loss = -float((np.log(p[:, labels, np.arange(n)] + 1e-9) * weight[:, 0]).sum())
    wrong = p.copy()
    wrong[:, labels, np.arange(n)] -= 1
    wrong *= weight
    joined = np.concatenate([both["f"], both["b"]], axis=1)
    grads = {"out": np.einsum("tln,thn->lh", wrong, joined), "bias": wrong.sum(axis=(0, 2))[:, None]}
    from_above = np.einsum("lh,tln->thn", net["out"], wrong)
    for way, above in (("f", from_above[:, :hidden]), ("b", from_above[:, hidden:])):
        x, u, hs = net[f"x{way}"], net[f"u{way}"], both[way]
        order = list(range(length)) if way == "f" else list(range(length - 1, -1, -1))
        du, through = np.zeros_like(u), np.zeros((hidden, n), np.float32)
        inputs = np.empty((length, 3 * hidden, n), np.float32)
        for k in range(length - 1, -1, -1):
            t = order[k]
            before = hs[order[k - 1]] if k else np.zeros((hidden, n), np.float32)
            z, r, part, c = gates(np.take(x, windows[:, t], axis=1), before, u, hidden)
            dh = above[t] + through
            dc = dh * z * (1 - c * c)
            dz = dh * (c - before) * z * (1 - z)
            dr = dc * part * r * (1 - r)
            recurrent = np.concatenate([dz, dr, dc * r])
            inputs[t] = np.concatenate([dz, dr, dc])
            du += recurrent @ before.T
            through = dh * (1 - z) + u.T @ recurrent
        grads[f"u{way}"] = du
        flat, codes = inputs.transpose(1, 0, 2).reshape(3 * hidden, -1), windows.T.ravel()
        grads[f"x{way}"] = np.stack([np.bincount(codes, row, 256) for row in flat]).astype(np.float32)
    return loss, grads


def train(windows: np.ndarray, real: np.ndarray, labels: np.ndarray, languages: int, hidden: int = HIDDEN, steps: int = 160, batch: int = 192, rate: float = 0.03, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over random batches, languages drawn equally often."""
    net, source = new_network(languages, hidden, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.items()}
    second = {k: np.zeros_like(v) for k, v in net.items()}
    share = 1 / np.maximum(np.bincount(labels, minlength=languages), 1)[labels]
    share /= share.sum()
    for step in range(1, steps + 1):
        take = source.choice(len(windows), min(batch, len(windows)), p=share)
        _, grads = gradients(net, windows[take], real[take], labels[take])
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net[k] = (net[k] - pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, real bytes, document of each window); the last of a text is padded."""
    lengths = np.diff(offsets)
    counts = -(-lengths // window)
    doc = np.repeat(np.arange(len(lengths)), counts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
    place = (offsets[doc] + start)[:, None] + np.arange(window)
    real = place < offsets[doc + 1][:, None]
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    return np.where(real, padded[np.minimum(place, len(data))], 0), real, doc


def document_probabilities(net: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean byte probabilities (documents, languages) of the texts of a slab."""
    languages, n = len(net["bias"]), len(offsets) - 1
    windows, real, doc = windows_of(data, offsets)
    sums = np.zeros((n, languages))
    step = SLAB // WINDOW
    for a in range(0, len(windows), step):
        p = position_probabilities(net, windows[a : a + step])
        mass = np.einsum("tln,nt->nl", p, real[a : a + step].astype(np.float32))
        for k in range(languages):
            sums[:, k] += np.bincount(doc[a : a + step], mass[:, k], n)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def training_windows(docs: DataFrame, per_language: int, sample_chars: int, per_text: int = 12):
    """(windows, real, labels, languages) of the bounded sample."""
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~is_held_out(F.col("doc_id")))
        .select("doc_id", "lang", F.substring("text", 1, sample_chars).alias("text"))
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= per_language)
        .orderBy("lang", "_n")
        .select("lang", "text")
        .collect()
    )
    languages = sorted({r["lang"] for r in rows})
    found, masks, labels = [np.zeros((0, WINDOW), np.uint8)], [np.zeros((0, WINDOW), bool)], []
    for r in rows:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        windows, real, _ = windows_of(data, np.array([0, len(data)]))
        kept = np.unique(np.linspace(0, len(windows) - 1, per_text).astype(int)) if len(windows) else []
        found.append(windows[kept])
        masks.append(real[kept])
        labels += [languages.index(r["lang"])] * len(kept)
    return np.concatenate(found), np.concatenate(masks), np.array(labels, np.int64), languages


def identify(docs: DataFrame, per_language: int = 250, sample_chars: int = 8192) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    windows, real, labels, languages = training_windows(docs, per_language, sample_chars)
    net = train(windows, real, labels, len(languages)) if languages else None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            letters = batch.column(2).to_pylist()
            for first, data, offsets in slabs(batch.column(1), 1 << 19):
                if shared.value is None:
                    names += ["und"] * (len(offsets) - 1)
                    scores += [0.0] * (len(offsets) - 1)
                    continue
                p = document_probabilities(shared.value, data, offsets)
                best = p.argmax(axis=1)
                for i, k in enumerate(best.tolist()):
                    known = bool(letters[first + i])
                    names.append(languages[k] if known else "und")
                    scores.append(float(min(1.0, p[i, k])) if known else 0.0)
            yield pa.record_batch(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("letters"))
    return map_arrow(read, predict, f"doc_id {kind}, lang_pred string, score double").select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )
