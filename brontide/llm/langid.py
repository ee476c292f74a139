"""Operator 1 - language identification by a bidirectional gated recurrent network over bytes.

Every whole text is read in runs of ``STEPS`` bytes, which overlap: both directions of the network read each run,
every position gets a distribution over the languages from the two states there, and the positions in the
middle of a run count, ``CONTEXT`` bytes or more from its ends, each letter of the text once. So no word is
judged by a part of it only for lying at an edge. A document's score is the mean over its letter positions, in all runs.

The network is trained in numpy by backpropagation through time, on a bounded sample of the labelled rows
(``SAMPLE_DOCS`` in all, as many of each language as there are, chosen by a hash of doc_id). The sample stays on the
executors; of each of its texts ``SAMPLE_RUNS`` runs, drawn from all over the text, come to the driver. The network
goes to the tasks as a few kilobytes.

Edge cases: a null text, or one without letters, is ``und`` with score 0. Equal scores go to the first
language in name order. With no usable label every text is ``und``. A null doc_id is held out only if
its remainder is 2, which null is not. Repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brontide.llm import wordhash as wh
from brontide.llm.shared import keyed

STEPS, CONTEXT, UNITS = 64, 8, 8
SAMPLE_DOCS, SAMPLE_RUNS = 2400, 12
_BLOCK = 2048
_EPOCHS_RUNS, _BATCH, _RATE = 330, 192, 0.02
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MIDDLE = np.zeros((STEPS, 1), dtype=np.float32)
_MIDDLE[CONTEXT : STEPS - CONTEXT] = 1


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax over both states at each position.

    For each direction: E (3H, 256) input table, U (3H, H), with rows for update, reset and candidate;
    the rows of the two gates are kept halved, as sigmoid(x) = (1 + tanh(x / 2)) / 2.
    """

    def __init__(self, classes: int, units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.units, self.classes = units, classes
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.E = [draw(3 * units, 256, scale=0.5) for _ in range(2)]
        self.U = [draw(3 * units, units, scale=units**-0.5) for _ in range(2)]
        self.V = draw(classes, 2 * units, scale=0.3)
        self.b = np.zeros((classes, 1), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.E, *self.U, self.V, self.b]

    def states(self, codes: np.ndarray, way: int) -> np.ndarray:
        """codes (T, B) of bytes -> states (T, H, B); way 0 reads forward, 1 backward."""
        steps, wide = codes.shape
        h, E, U = self.units, self.E[way], self.U[way]
        out = np.empty((steps, h, wide), dtype=np.float32)
        state = np.zeros((h, wide), dtype=np.float32)
        x = np.empty((3 * h, wide), dtype=np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(E, codes[t], axis=1, out=x, mode="clip")
            inner = U @ state
            gates = x[: 2 * h]
            gates += inner[: 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new = inner[2 * h :]
            new *= gates[h:]
            new += x[2 * h :]
            np.tanh(new, out=new)
            state = out[t]
            prev = out[t - 1] if way == 0 and t else out[t + 1] if way and t + 1 < steps else 0
            np.subtract(prev, new, out=state)
            state *= gates[:h]
            state += new
        return out

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """(T, C, B)"""
        h = self.units
        f, g = self.states(codes, 0), self.states(codes, 1)
        return np.matmul(self.V[:, :h], f) + np.matmul(self.V[:, h:], g) + self.b

    def probabilities(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Sums over the masked positions of each run's distributions: (C, B)."""
        z = self.logits(codes)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (mask / z.sum(axis=1))[:, None, :]
        return z.sum(axis=0)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of all masked positions, by backpropagation through time."""
        steps, wide = codes.shape
        h = self.units
        z = self.logits(codes)
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        z[:, target, np.arange(wide)] -= 1
        z *= (mask * weight / max(mask.sum(), 1))[:, None, :]
        grads = [np.zeros_like(p) for p in self.params()]
        grads[5][:] = z.sum(axis=(0, 2))[:, None]
        for way in (0, 1):
            E, U = self.E[way], self.U[way]
            s = self.states(codes, way)
            part = slice(way * h, way * h + h)
            grads[4][:, part] = np.tensordot(z, s, axes=((0, 2), (0, 2)))
            carry = np.zeros((h, wide), dtype=np.float32)
            rows = np.empty((steps, 3 * h, wide), dtype=np.float32)
            for t in range(steps - 1, -1, -1) if way == 0 else range(steps):
                p = t - 1 if way == 0 else t + 1
                prev = s[p] if 0 <= p < steps else np.zeros((h, wide), dtype=np.float32)
                x, inner = np.take(E, codes[t], axis=1), U @ prev
                gates = 0.5 * np.tanh(x[: 2 * h] + inner[: 2 * h]) + 0.5
                u, r = gates[:h], gates[h:]
                new = np.tanh(x[2 * h :] + r * inner[2 * h :])
                d = self.V[:, part].T @ z[t] + carry
                dn = d * (1 - u) * (1 - new * new)
                du = d * (prev - new) * 2 * u * (1 - u)
                dr = dn * inner[2 * h :] * 2 * r * (1 - r)
                back = np.concatenate([du, dr, dn * r])
                grads[2 + way] += back @ prev.T
                carry = d * u + U.T @ back
                rows[t] = np.concatenate([du, dr, dn])
            flat = codes.ravel()
            for k in range(3 * h):
                grads[way][k] = np.bincount(flat, weights=rows[:, k].ravel(), minlength=256)
        return grads


def train(runs: np.ndarray, target: np.ndarray, classes: int, steps: int = _EPOCHS_RUNS, seed: int = 11) -> Network:
    """Adam over batches of runs (N, STEPS) with as many of each class."""
    net, rng = Network(classes), np.random.default_rng(seed)
    own = [np.flatnonzero(target == c) for c in range(classes)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    for k in range(1, steps + 1):
        pick = np.concatenate([o[rng.integers(0, len(o), max(1, _BATCH // classes))] for o in own])
        codes = np.ascontiguousarray(runs[pick].T)
        grads = net.gradients(codes, _LETTER[codes] * _MIDDLE, target[pick], np.float32(1))
        rate = _RATE * min(1, k / 20) * (1 - 0.9 * k / steps)
        for p, g, (m, v) in zip(net.params(), grads, moments, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
    return net


def _runs(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs (N, STEPS) of a slice's texts, whose middles tile the texts, padded by byte 0, and the text of each."""
    size, stride = np.diff(offs), STEPS - 2 * CONTEXT
    count = -(-size // stride)
    doc = np.repeat(np.arange(len(size)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    at = (offs[:-1][doc] + k * stride - CONTEXT)[:, None] + np.arange(STEPS)[None, :]
    inside = (at < offs[1:][doc][:, None]) & (at >= offs[:-1][doc][:, None])
    return np.where(inside, np.append(flat, 0)[np.where(inside, at, len(flat))], 0).astype(np.uint8), doc


def _drawn(batches):
    """lang and a run, for up to SAMPLE_RUNS runs of each text."""
    for batch in batches:
        langs, out = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            flat = np.frombuffer(text.encode(), dtype=np.uint8)
            runs, _ = _runs(flat, np.array([0, len(flat)]))
            rng = np.random.default_rng(zlib.crc32(flat.tobytes()))
            for run in runs[rng.permutation(len(runs))[:SAMPLE_RUNS]]:
                if _LETTER[run[CONTEXT : STEPS - CONTEXT]].any():
                    langs.append(lang)
                    out.append(run.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "run"])


def sample(docs: DataFrame, rows: int = SAMPLE_DOCS) -> list[tuple[str, bytes]]:
    """(lang, run) of about ``rows`` labelled rows outside the held-out quarter, evenly over the languages."""
    seen = docs.where("lang is not null and text is not null").where(~held_out())
    counts = seen.groupBy("lang").agg(F.count("*").alias("n"))
    # the number of languages is that of the labels in use, which the corpus' size doesn't change
    share = F.broadcast(counts.select("lang", F.least(F.lit(1.0), F.greatest(F.lit(1.0), rows / F.count("*").over(Window.partitionBy())) / F.col("n")).alias("share")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = seen.join(share, "lang").where(draw <= F.col("share")).orderBy(F.xxhash64("doc_id", "lang"), "text").limit(2 * rows).select("lang", "text")
    return [(r["lang"], r["run"]) for r in picked.mapInArrow(_drawn, "lang string, run binary").orderBy("lang", "run").collect()]


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, rows: int = SAMPLE_DOCS) -> tuple[Network | None, list[str]]:
    drawn = sample(docs.select("doc_id", "text", "lang"), rows)
    names = sorted({lang for lang, _ in drawn})
    if not names:
        return None, []
    number = {lang: k for k, lang in enumerate(names)}
    return train(np.array([np.frombuffer(run, np.uint8) for _, run in drawn]), np.array([number[lang] for lang, _ in drawn]), len(names)), names


def _predict(model):
    def run(batches):
        net, names = model.value
        for batch in batches:
            texts = batch.column(1)
            total = np.zeros((len(texts), max(1, len(names))))
            letters = np.zeros(len(texts), dtype=np.int64)
            plain = np.zeros(len(texts), dtype=bool)
            for first, flat, offs in wh.slices(texts):
                sums = np.append(0, np.cumsum(_LETTER[flat]))
                letters[first : first + len(offs) - 1] = np.diff(sums[offs])
                sums = np.append(0, np.cumsum(_LETTER[flat] & (flat < 128)))
                plain[first : first + len(offs) - 1] = np.diff(sums[offs]) > 0
                if net is None or not len(flat):
                    continue
                runs, doc = _runs(flat, offs)
                for a in range(0, len(runs), _BLOCK):
                    codes = np.ascontiguousarray(runs[a : a + _BLOCK].T)
                    p = net.probabilities(codes, _LETTER[codes] * _MIDDLE)
                    here = doc[a : a + _BLOCK]
                    at = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
                    np.add.at(total, first + here[at], np.add.reduceat(p.astype(np.float64), at, axis=1).T)
            # bytes beyond ASCII may be signs: only texts without an ASCII letter need the slower look
            for k in np.flatnonzero((letters > 0) & ~plain):
                letters[k] *= any(c.isalpha() for c in texts[int(k)].as_py())
            known = (letters > 0) & (net is not None)
            best = total.argmax(axis=1)
            score = np.where(known, total[np.arange(len(texts)), best] / np.maximum(letters, 1), 0.0)
            lang = [names[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: tuple[Network | None, list[str]]) -> DataFrame:
    """doc_id, lang_pred, score: a row for each of docs (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_predict(spark.sparkContext.broadcast(model)), keyed(docs, "lang_pred string, score double"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
