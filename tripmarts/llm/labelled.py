"""A bounded sample of labelled texts for fitting a classifier, and a weighted logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a sample: documents of each class, and characters of a document that may be in it.
PER_CLASS = 3000
SAMPLE_CHARS = 20_000


def fold(id_col: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("null"))) % k


def sample(docs: DataFrame, labels: DataFrame, label_col: str, k: int, held_out: int, id_col: str = "doc_id", text_col: str = "text",
           per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, int, float]]:
    """(text, label, weight) of at most per_class documents a class whose fold isn't held_out, in a fixed order.

    The documents with the least id hashes are taken; weights restore the class sizes among all training labels. Rows with a null id
    or a label other than 0 and 1 are left out; an id with both labels counts as 1; of texts that share an id the least is taken.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    train = known.where(fold("id", k) != held_out).groupBy("id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    hashed = train.withColumn("h", F.xxhash64("id"))
    picked = [hashed.where(F.col("y") == y).orderBy("h", "id").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where(F.length("text") <= sample_chars).join(chosen, "id")
    found = rows.groupBy("h", "id", "y").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: (r["h"], str(r["id"])))
    n = {y: sum(r["y"] == y for r in found) for y in (0, 1)}
    return [(r["text"], r["y"], sizes[r["y"]] / n[r["y"]]) for r in found]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (intercept first), means and scales of a ridge logistic regression by Newton's steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = weight / weight.mean()
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(beta))
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p) + 1e-12)[:, None]).T @ a + penalty, a.T @ (w * (y - p)) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return beta, mean, scale


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    beta, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(beta[0] + ((x - mean) / scale) @ beta[1:], -30, 30)))
