"""Toxicity by compression distance: two zstandard dictionaries, windows, calibrated thresholds.

Fit, on a bounded sample of labelled documents (labelled.PER_CLASS a class, labelled.SAMPLE_CHARS characters a document):

1. A dictionary is trained on windows of ordinary documents.
2. Toxic passages are the words of toxic documents that are over-represented there (log odds of the document frequencies); a
   second dictionary is trained on them alone; as training cuts words, the passages also stand in it whole, frequent ones last.
3. A window is compressed twice: with the ordinary dictionary, and with both dictionaries one after the other. So the two lengths
   differ by what the toxic passages save, and by nothing else.
4. A logistic curve turns the savings of a document's windows into a probability. It is fitted on savings by dictionaries that haven't
   seen the document (PARTS parts, each scored by dictionaries of the others); weights restore the share of toxic labels.

Every window of every whole text is compressed (WINDOW bytes, each STEP bytes, so that neighbours overlap). Only the two
dictionaries and a few numbers go to the tasks. No shuffle in scoring.

A null text is empty: it has one empty window and the score of a document without any saving. Repeated rows get the same score
each. Without labels of both classes every score is the share of label 1 (0 without labels). A null id belongs to the fold of
the text 'null'. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from tripmarts.llm import labelled
from tripmarts.llm.common import fresh_name, id_and_text, map_columns

WINDOW, STEP = 64, 48
DICTIONARY_BYTES = 8192
PARTS = 3
#: What stands between the entropy tables and the content of a trained dictionary: the first three repeat offsets, 1, 4 and 8.
OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"
PUNCTUATION = ".,;:!?\"'()"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    curve: tuple | None
    base_rate: float


def windows(text: str) -> list[bytes]:
    data = text.lower().encode()
    return [data[i:i + WINDOW] for i in range(0, max(1, len(data) - (WINDOW - STEP)), STEP)]


def compressor(dictionary: bytes) -> Callable[[bytes], bytes]:
    """Level and match finder for short windows; no frame header fields."""
    import zstandard as zstd

    params = zstd.ZstdCompressionParameters.from_level(6, strategy=zstd.STRATEGY_LAZY2, min_match=4, write_content_size=False, write_dict_id=False,
                                                       write_checksum=False, format=zstd.FORMAT_ZSTD1_MAGICLESS)
    kept = zstd.ZstdCompressionDict(dictionary, dict_type=zstd.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
    return zstd.ZstdCompressor(dict_data=kept, compression_params=params).compress


def train_dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """Content of a trained dictionary, without its entropy tables; too few samples for training are the content themselves."""
    import zstandard as zstd

    try:
        trained = zstd.train_dictionary(size + 512, samples, k=segment, d=6, level=3).as_bytes()
    except zstd.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]
    start = trained.find(OFFSETS)
    return trained[start + len(OFFSETS) if start >= 0 else 0:]


def group_of(text: str) -> int:
    """Equal for copies and for most near copies: the least hash of three words in a row."""
    words = text.lower().split()
    return min((crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))))


def toxic_words(docs: list[tuple[str, int, float]]) -> list[bytes]:
    """Each over-represented word of toxic documents, once for each group of copies that has it, with blanks around it.

    Frequencies count groups, not documents, so that text which only copies of one document share isn't taken for toxic.
    """
    groups: tuple[dict, dict] = ({}, {})
    for text, y, _ in docs:
        groups[y].setdefault(group_of(text), set()).update({w.strip(PUNCTUATION) for w in text.lower().split()} - {""})
    seen = [Counter(w for words in g.values() for w in words) for g in groups]
    n = [len(g) for g in groups]
    odds = {w: math.log((c + 0.5) / (n[1] + 1)) - math.log((seen[0][w] + 0.5) / (n[0] + 1)) for w, c in seen[1].items() if c >= max(2, 0.012 * n[1])}
    chosen = {w for w, x in odds.items() if x > 2.5}
    return [f" {w} ".encode() for words in groups[1].values() for w in sorted(words & chosen)]


def savings(texts: list[str], ordinary: Callable[[bytes], bytes], both: Callable[[bytes], bytes]) -> np.ndarray:
    """Per text: largest and second largest saving of a window, windows that save at least 2, 3, 4, 5 and 6 bytes, all windows (logs)."""
    out = np.zeros((len(texts), 8))
    for k, text in enumerate(texts):
        d = np.array([len(ordinary(w)) - len(both(w)) for w in windows(text)])
        top = np.sort(d)[-2:]
        out[k] = [top[-1], top[0], *(np.log1p((d >= m).sum()) for m in (2, 3, 4, 5, 6)), np.log1p(len(d))]
    return out


def dictionaries(docs: list[tuple[str, int, float]]) -> tuple[bytes, bytes]:
    ordinary = train_dictionary([w for t, y, _ in docs if not y for w in windows(t)], DICTIONARY_BYTES, 24)
    passages = toxic_words(docs)
    whole = b"".join(p for p, _ in reversed(Counter(passages).most_common()))  # frequent ones last, where offsets are shortest
    return ordinary, train_dictionary(passages, DICTIONARY_BYTES // 4, 12) + whole[-DICTIONARY_BYTES // 4:]


def fit(docs: list[tuple[str, int, float]]) -> Model:
    total = sum(w for *_, w in docs)
    rate = sum(w for _, y, w in docs if y) / total if total else 0.0
    parts = [[d for i, d in enumerate(docs) if i % PARTS == k] for k in range(PARTS)]
    others = [[d for i, d in enumerate(docs) if i % PARTS != k] for k in range(PARTS)]
    if any(len({y for _, y, _ in o}) < 2 for o in [docs, *others]):
        return Model(b"", b"", None, rate)
    x, y, w = [], [], []
    for part, rest in zip(parts, others, strict=True):
        ordinary, toxic = dictionaries(rest)
        x.append(savings([t for t, *_ in part], compressor(ordinary), compressor(toxic + ordinary)))
        y += [label for _, label, _ in part]
        w += [weight for *_, weight in part]
    return Model(*dictionaries(docs), labelled.logistic(np.concatenate(x), np.array(y), np.array(w)), rate)


def _scorer(model: Model) -> Callable[[], Callable[[list[str]], list[pa.Array]]]:
    def make():
        ordinary, both = compressor(model.ordinary), compressor(model.toxic + model.ordinary)

        def work(texts: list[str]) -> list[pa.Array]:
            if model.curve is None:
                return [pa.array([model.base_rate] * len(texts), pa.float64())]
            return [pa.array(labelled.probability(model.curve, savings(texts, ordinary, both)))]
        return work
    return make


def with_score(docs: DataFrame, model: Model, text_col: str, out_col: str, drop_text: bool = False) -> DataFrame:
    return map_columns(docs, text_col, _scorer(model), [StructField(out_col, DoubleType())], drop_text)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, threshold: float, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    model = fit(labelled.sample(docs, labels, label_col, folds, held_out, id_col, text_col))
    scored = with_score(id_and_text(docs, id_col, text_col), model, "text_", "score", drop_text=True)
    return scored.select(id_col, (labelled.fold(id_col, folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, folds: int, held_out: int, threshold: float, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "toxic") -> DataFrame:
    """The rows of docs below the threshold, with all their columns."""
    model = fit(labelled.sample(docs, labels, label_col, folds, held_out, id_col, text_col))
    score = fresh_name(docs.columns, "toxicity_score")
    return with_score(docs, model, text_col, score).where(F.col(score) < threshold).drop(score)
