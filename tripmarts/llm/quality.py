"""Quality scores by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j), with the pairs in linear time:
half the sum over factors f of (sum v_if x_i)^2 - sum v_if^2 x_i^2.

Inputs x: distinct lower-case words hashed into BUCKETS columns (log counts, scaled to length 1), and the columns of STRUCTURE,
standardised and cut at CLIP deviations. Metadata here means sizes derived from the text (bytes, words, lines); id, source, language
and labels are never inputs.

Fit: Adam on a bounded sample of labelled documents (labelled.PER_CLASS a class, labelled.SAMPLE_CHARS characters a document), weights
restore the class sizes, a fixed seed makes it repeatable. Scoring reads every whole text, batch by batch, without a shuffle;
the parameters that go to the tasks have a fixed size.

A null text is empty and scored from its structure alone. Repeated rows get the same score each. Without labels of both
classes every score is the share of label 1 (0 without labels). A null id belongs to the fold of the text 'null'. An empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tripmarts.llm import labelled
from tripmarts.llm.common import id_and_text, map_columns

BUCKETS, FACTORS = 1 << 13, 8
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.02, 1e-5
CLIP = 5.0
WORD_CACHE = 400_000
STRUCTURE = ("log bytes", "log words", "log lines", "bytes a word", "words a line", "distinct words", "most frequent word", "repeats of the word before",
             "letters", "upper case", "digits", "white space", "full stops and commas", "other marks", "bars and brackets", "non-ASCII bytes", "repeated lines",
             "words without letters", "words a sentence")
KIND = np.full(256, 5, np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,", None, b"|[]{}<>_/\\", None)):
    if _chars:
        KIND[list(_chars)] = _kind
KIND[128:] = 7


class Buckets(dict):
    """Word -> column; dropped when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = out = crc32(word.encode()) % BUCKETS
        return out


def inputs(text: str, buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, values) of the words, and the structure statistics before scaling."""
    data = text.encode()
    words = text.lower().split()
    counts = Counter(words)
    lines = text.split("\n")
    n, m = max(1, len(words)), max(1, len(data))
    kinds = np.bincount(KIND[np.frombuffer(data, np.uint8)], minlength=8) / m
    repeats = sum(map(eq, words, words[1:])) if len(words) > 1 else 0
    stats = np.array([np.log1p(len(data)), np.log1p(len(words)), np.log1p(len(lines)), len(data) / n, np.log1p(n / len(lines)), len(counts) / n,
                      max(counts.values(), default=0) / n, repeats / n, kinds[0] + kinds[1], kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7],
                      1 - len(set(lines)) / len(lines), sum(not w[0].isalpha() for w in counts) / max(1, len(counts)), np.log1p(n / (1 + data.count(b".")))])
    cols = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    vals = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    return cols, vals / max(1e-9, np.sqrt((vals * vals).sum())), stats


@dataclass(frozen=True)
class Machine:
    """Parameters; rows 0 to BUCKETS of w and v are words, the others structure."""
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def design(self, texts: list[str], buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All inputs of a batch as columns, values and the first place of each text."""
        cols, vals, starts, at = [], [], [], 0
        fixed = BUCKETS + np.arange(len(STRUCTURE))
        for text in texts:
            c, x, s = inputs(text, buckets)
            cols += [fixed, c]
            vals += [np.clip((s - self.mean) / self.scale, -CLIP, CLIP) / np.sqrt(len(STRUCTURE)), x]
            starts.append(at)
            at += len(c) + len(fixed)
        return np.concatenate(cols), np.concatenate(vals), np.array(starts)

    def score(self, cols: np.ndarray, vals: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.v[cols] * vals[:, None]
        total, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        z = self.w0 + np.add.reduceat(self.w[cols] * vals, starts) + 0.5 * (total * total - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: list[tuple[str, int, float]]) -> Machine | float:
    """The machine, or the share of label 1 if one class has no documents."""
    total = sum(w for *_, w in docs)
    rate = sum(w for _, y, w in docs if y) / total if total else 0.0
    if len({y for _, y, _ in docs}) < 2:
        return rate
    buckets, rng = Buckets(), np.random.default_rng(7)
    rows = [inputs(t, buckets) for t, *_ in docs]
    stats = np.array([s for *_, s in rows])
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    size = BUCKETS + len(STRUCTURE)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    machine = Machine(0.0, w, v, mean, scale)
    fixed = BUCKETS + np.arange(len(STRUCTURE))
    full = [(np.concatenate([fixed, c]), np.concatenate([np.clip((s - mean) / scale, -CLIP, CLIP) / np.sqrt(len(STRUCTURE)), x])) for c, x, s in rows]
    y, weight = np.array([y for _, y, _ in docs], float), np.array([k for *_, k in docs])
    weight = weight / weight.mean()
    w0 = float(np.log(rate / (1 - rate)))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, v)]
    m0 = [0.0, 0.0]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            cols, vals = np.concatenate([full[i][0] for i in part]), np.concatenate([full[i][1] for i in part])
            sizes = np.array([len(full[i][0]) for i in part])
            starts = np.cumsum(sizes) - sizes
            vx = v[cols] * vals[:, None]
            total = np.add.reduceat(vx, starts)
            z = w0 + np.add.reduceat(w[cols] * vals, starts) + 0.5 * (total * total - np.add.reduceat(vx * vx, starts)).sum(1)
            g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            each = np.repeat(g, sizes)
            gw, gv = DECAY * w, DECAY * v
            np.add.at(gw, cols, each * vals)
            np.add.at(gv, cols, (each * vals)[:, None] * (np.repeat(total, sizes, axis=0) - vx))
            step += 1
            for p, grad, (a, b) in zip((w, v), (gw, gv), moments, strict=True):
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            m0[0] += 0.1 * (g.sum() - m0[0])
            m0[1] += 0.001 * (g.sum() ** 2 - m0[1])
            w0 -= RATE * (m0[0] / (1 - 0.9**step)) / (np.sqrt(m0[1] / (1 - 0.999**step)) + 1e-8)
    return Machine(w0, w, v, machine.mean, machine.scale)


def _scorer(model: Machine | float) -> Callable[[], Callable[[list[str]], list[pa.Array]]]:
    def make():
        buckets = Buckets()

        def work(texts: list[str]) -> list[pa.Array]:
            if isinstance(model, float):
                return [pa.array([model] * len(texts), pa.float64())]
            parts = [model.score(*model.design(texts[i:i + 256], buckets)) for i in range(0, len(texts), 256)]
            return [pa.array(np.concatenate(parts))]
        return work
    return make


def quality(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, threshold: float, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    model = fit(labelled.sample(docs, labels, label_col, folds, held_out, id_col, text_col))
    scored = map_columns(id_and_text(docs, id_col, text_col), "text_", _scorer(model), [StructField("score", DoubleType())], drop_text=True)
    return scored.select(id_col, (labelled.fold(id_col, folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
