"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's bytes in opposite directions; at every position a linear layer over both states
gives language probabilities, and a document's are their mean over all its positions. Texts are read
whole, in stretches of ``STRETCH`` bytes that start from empty states; stretches of many documents run as one
batch. The network is trained on the driver in numpy, by backpropagation through time with Adam, on a
bounded sample: some ``per_lang`` documents of each language, chosen by hash of row, and up to
``WINDOWS`` windows spread over each whole text. The ``most_langs`` languages with the most labelled rows are
learned; where there are more, as in tables with stray tags, texts of a rarer one get the learned language they are most like.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without doc_id are
not held out and teach nothing; without any labelled row all texts are ``und``; with one language all
texts with letters are that; repeated rows score alike; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpulse.llm.common import ready

HIDDEN, STRETCH, BATCH = 8, 128, 1024
PER_LANG, WINDOWS, WINDOW, MOST_LANGS = 400, 12, 64, 200
STEPS, RATE, TRAIN_BATCH, SEED = 300, 0.02, 128, 17
UNKNOWN = "und"
Arrays = dict[str, np.ndarray]


class Network(NamedTuple):
    langs: list[str]
    weights: Arrays


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def start_weights(langs: int, hidden: int, rng: np.random.Generator) -> Arrays:
    out: Arrays = {}
    for d in "fb":
        out[f"W{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
        out[f"U{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        out[f"O{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, langs))
    out["c"] = np.zeros(langs)
    return {k: v.astype(np.float32) for k, v in out.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run_direction(x: np.ndarray, live: np.ndarray | None, w: np.ndarray, u: np.ndarray, reverse: bool, trace: list | None = None) -> np.ndarray:
    """States (time, batch, hidden) of one GRU over bytes x (time, batch). live: 0 where a stretch has ended."""
    steps, batch = x.shape
    size = u.shape[0]
    states = np.empty((steps, batch, size), np.float32)
    h = np.zeros((batch, size), np.float32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        given, own = w[x[t]], h @ u
        gates = given[:, :2 * size] + own[:, :2 * size]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :size], gates[:, size:]
        n = np.tanh(given[:, 2 * size:] + r * own[:, 2 * size:])
        new = h - n
        new *= z
        new += n
        if live is not None:
            new *= live[t][:, None]
        if trace is not None:
            trace.append((t, h, z, r, n, own[:, 2 * size:]))
        states[t] = h = new
    return states


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(x: np.ndarray, y: np.ndarray, w: Arrays) -> tuple[float, Arrays]:
    """Mean cross-entropy over all positions and its gradient, through time."""
    steps, batch = x.shape
    traces: dict[str, list] = {"f": [], "b": []}
    states = {d: run_direction(x, None, w[f"W{d}"], w[f"U{d}"], d == "b", traces[d]) for d in "fb"}
    p = softmax(states["f"] @ w["Of"] + states["b"] @ w["Ob"] + w["c"])
    loss = float(-np.log(p[:, np.arange(batch), y] + 1e-9).mean())
    p[:, np.arange(batch), y] -= 1
    p /= steps * batch
    out: Arrays = {"c": p.sum(axis=(0, 1))}
    for d in "fb":
        size = w[f"U{d}"].shape[0]
        out[f"O{d}"] = np.tensordot(states[d], p, axes=([0, 1], [0, 1]))
        into = p @ w[f"O{d}"].T
        dw, du = np.zeros_like(w[f"W{d}"]), np.zeros_like(w[f"U{d}"])
        dh = np.zeros((batch, size), np.float32)
        for t, before, z, r, n, own_n in reversed(traces[d]):
            dh = dh + into[t]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * own_n * r * (1 - r)
            given = np.concatenate([dz, dr, dn], axis=1)
            own = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(dw, x[t], given)
            du += before.T @ own
            dh = dh * z + own @ w[f"U{d}"].T
        out[f"W{d}"], out[f"U{d}"] = dw, du
    return loss, out


def train(windows: list[bytes], langs: list[int], n_langs: int, hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Arrays:
    """Weights fitted with Adam; every batch has the languages in equal shares."""
    rng = np.random.default_rng(seed)
    x = np.stack([np.frombuffer(w.ljust(WINDOW, b" ")[:WINDOW], np.uint8) for w in windows])
    y = np.array(langs)
    by_lang = [np.flatnonzero(y == k) for k in range(n_langs)]
    w = start_weights(n_langs, hidden, rng)
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        lang = np.arange(TRAIN_BATCH) % n_langs if n_langs <= TRAIN_BATCH else rng.integers(0, n_langs, TRAIN_BATCH)
        rows = np.array([by_lang[k][rng.integers(len(by_lang[k]))] for k in lang])
        _, slope = gradients(x[rows].T, y[rows], w)
        norm = np.sqrt(sum(float((g * g).sum()) for g in slope.values()))
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in slope.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            w[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def pooled(texts: list[bytes], w: Arrays) -> np.ndarray:
    """Mean language probabilities over all positions of each text; zeros for an empty one."""
    n_langs = len(w["c"])
    total, sizes = np.zeros((len(texts), n_langs)), np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(np.append(0, sizes[:-1])) if len(sizes) else sizes
    counts = -(-sizes // STRETCH)
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[owner] + nth * STRETCH
    length = np.minimum(STRETCH, begin[owner] + sizes[owner] - start)
    # Stretches of like length run together, so that short texts cost what they hold.
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), BATCH):
        rows = order[at:at + BATCH]
        steps = int(length[rows[0]])
        place = np.arange(steps)[:, None]
        live = (place < length[rows][None, :])
        x = raw[np.minimum(start[rows][None, :] + place, len(raw) - 1)]
        mask = None if live.all() else live.astype(np.float32)
        logits = run_direction(x, mask, w["Wf"], w["Uf"], False) @ w["Of"]
        logits += run_direction(x, mask, w["Wb"], w["Ub"], True) @ w["Ob"]
        logits += w["c"]
        np.exp(logits - logits.max(axis=-1, keepdims=True), out=logits)
        logits /= logits.sum(axis=-1, keepdims=True)
        if mask is not None:
            logits *= mask[:, :, None]
        np.add.at(total, owner[rows], logits.sum(axis=0, dtype=np.float64))
    return total / np.maximum(sizes, 1)[:, None]


def label_positions(text: bytes, network: Network) -> list[str]:
    """The likeliest language at every byte of one text."""
    if not text:
        return []
    w = network.weights
    out = []
    for at in range(0, len(text), STRETCH):
        x = np.frombuffer(text[at:at + STRETCH], np.uint8)[:, None]
        logits = run_direction(x, None, w["Wf"], w["Uf"], False) @ w["Of"] + run_direction(x, None, w["Wb"], w["Ub"], True) @ w["Ob"] + w["c"]
        out += [network.langs[k] for k in logits[:, 0].argmax(axis=1)]
    return out


def fit(documents: DataFrame, per_lang: int = PER_LANG, most_langs: int = MOST_LANGS, **training: int) -> Network:
    """The network learned from rows that are not held out."""
    ready(documents.sparkSession)
    source = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = source.where("doc_id is not null and lang is not null and length(text) > 0").where(~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()
    if not counts:
        return Network([], {})
    langs = sorted(r["lang"] for r in counts)
    # A language's share of its rows by hash; bounded per language up to chance. Copies of a row are one.
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, per_lang / r["count"]))) for r in counts])
    row = F.xxhash64("doc_id", "text", F.lit(3))
    chosen = known.where(F.pmod(row, F.lit(1 << 30)) < share * (1 << 30)).distinct()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, windows = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                for at in sorted({int(a) for a in np.linspace(0, max(0, len(raw) - WINDOW), WINDOWS)}):
                    lang.append(name)
                    windows.append(raw[at:at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(windows, pa.binary())], names=["lang", "window"])

    rows = chosen.select("lang", "text").mapInArrow(take, "lang string, window binary").collect()
    rows = sorted((r.lang, bytes(r.window)) for r in rows)
    present = sorted({r[0] for r in rows})
    return Network(present or langs[:1], train([r[1] for r in rows], [present.index(r[0]) for r in rows], len(present), **training) if rows else {})


def identify_languages(documents: DataFrame, **parameters: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    network = documents.sparkSession.sparkContext.broadcast(fit(documents, **parameters))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = network.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if langs and any(c.isalpha() for c in t)]
            p = pooled([texts[i].encode() for i in at], weights) if at and weights else np.ones((len(at), 1))
            for i, row in zip(at, p, strict=True):
                lang[i], score[i] = langs[int(row.argmax())], float(min(1.0, row.max()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(predict, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
