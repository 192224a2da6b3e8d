"""Language identification with error-correcting output codes.

Every language has a codeword. A linear classifier on hashed byte n-grams predicts each
bit; a text gets the language whose codeword has the smallest weighted loss.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, portions, remainder, spread_rows, with_fields

BUCKETS = 2**13
ROWS = 128
UNKNOWN = "und"
_LETTER = re.compile("[A-Za-z]")
# ASCII letters lower-cased, other ASCII to blanks, bytes of longer characters as they are.
_BYTES = bytes(b if b >= 0x80 else (b | 0x20) if chr(b).isalpha() else 0x20 for b in range(256))


@dataclass(frozen=True)
class LanguageSpec:
    """``sample_rows`` bounds the labelled rows that are fitted, in equal parts by language (20 each at least)."""

    sample_rows: int = 3_000
    steps: int = 150
    rate: float = 0.5
    penalty: float = 1e-5
    ambiguous: float = 0.2
    seed: int = 11


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of n-gram shares (two and three bytes), a row of unit length per text."""
    clean = [t.translate(_BYTES) for t in texts]
    sizes = np.asarray([len(t) + 3 for t in clean], np.int64)
    raw = np.frombuffer(b"".join(b" " + t + b"  " for t in clean), np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(clean), dtype=np.int64) * BUCKETS, sizes)
    two = (raw[:-1] * np.uint32(0x9E3779B1) + raw[1:] * np.uint32(0x85EBCA77)) >> np.uint32(19)
    three = ((raw[:-2] * np.uint32(0xC2B2AE3D)) ^ (raw[1:-1] * np.uint32(0x27D4EB2F)) ^ (raw[2:] * np.uint32(0x165667B1))) * np.uint32(0x9E3779B1) >> np.uint32(19)
    size = len(clean) * BUCKETS
    counts = np.bincount(doc[:-1] + two, minlength=size) + np.bincount(doc[:-2] + three, minlength=size)
    shares = counts.reshape(len(clean), BUCKETS).astype(np.float32)
    return np.sqrt(shares / np.maximum(shares.sum(axis=1, keepdims=True), 1))


def codewords(k: int, seed: int) -> np.ndarray:
    """Rows of +1 and -1: every split of up to five languages, else the random code with the largest least distance."""
    if k <= 5:
        columns = range(1, max(2, 2 ** (k - 1)))
        return np.asarray([[1 if row == 0 or not (c >> (row - 1)) & 1 else -1 for c in columns] for row in range(k)], np.float32)
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = rng.choice(np.asarray([-1, 1], np.float32), (k, int(np.ceil(10 * np.log2(k)))))
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * code.shape[1]
        if apart.min() > least and (np.abs(code.sum(axis=0)) < k).all():
            best, least = code, apart.min()
    if best is None:
        raise ValueError("no code splits the languages")
    return best


def train(x: np.ndarray, languages: list[str], spec: LanguageSpec) -> LanguageModel:
    """Logistic classifiers for all bits at once, by gradient steps with momentum."""
    names = sorted(set(languages))
    code = codewords(len(names), spec.seed)
    place = np.searchsorted(names, languages)
    y = code[place]
    row_weight = (1 / np.bincount(place))[place][:, None].astype(np.float32)
    row_weight /= row_weight.sum()
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    move_w, move_b, scale = np.zeros_like(w), np.zeros_like(b), np.float32(20)
    for _ in range(spec.steps):
        slope = -y / (1 + np.exp(np.clip(y * (scale * (x @ w) + b), -30, 30))) * row_weight
        move_w = 0.9 * move_w - spec.rate * (scale * (x.T @ slope) + spec.penalty * w)
        move_b = 0.9 * move_b - spec.rate * slope.sum(axis=0)
        w, b = w + move_w, b + move_b
    margins = y * (scale * (x @ w) + b)
    right = np.stack([(margins[place == i] > 0).mean(axis=0) for i in range(len(names))]) + 1e-3
    return LanguageModel(names, code, scale * w, b, (right / right.sum(axis=1, keepdims=True)).astype(np.float32))


def decode(model: LanguageModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share of the decoding weight, and the second share, by loss-weighted distance."""
    margins = x @ model.weights + model.bias
    loss = np.logaddexp(0, -margins[:, None, :] * model.code[None, :, :])
    distance = (loss * model.trust[None, :, :]).sum(axis=2)
    likely = np.exp(-(distance - distance.min(axis=1, keepdims=True)) * model.code.shape[1] / 2)
    share = likely / likely.sum(axis=1, keepdims=True)
    best = distance.argmin(axis=1)
    top = share[np.arange(len(best)), best]
    share[np.arange(len(best)), best] = 0
    return best, top, share.max(axis=1)


def _feature_rows(rows: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, 4_000_000):
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = features([t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), part.column(2)], names=["doc_id", "x", "lang"])

    return in_tasks(rows, task, "doc_id bigint, x binary, lang string")


def fit(docs: DataFrame, spec: LanguageSpec = LanguageSpec()) -> LanguageModel | None:
    """Train on a bounded sample of ``docs`` with text and language, chosen by hash of the id.

    At most ``spec.sample_rows`` rows (20 a language at least) reach the driver, as n-gram
    shares of their whole texts. None if no row has a language.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    known = rows.select("lang").distinct().count()
    if not known:
        return None
    each = max(20, spec.sample_rows // known)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(spec.seed)), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= each).select("doc_id").distinct()
    # at most sample_rows ids, or 20 a language
    sample = rows.join(F.broadcast(ids), "doc_id")
    got = _feature_rows(sample.select("doc_id", "text", "lang")).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["x"])))
    if not got:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    return train(x, [r["lang"] for r in got], spec)


def identify(docs: DataFrame, model: LanguageModel | None, spec: LanguageSpec = LanguageSpec()) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` in [0, 1] and ``ambiguous``, from the whole text alone.

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if
    there is no model. ``ambiguous``: the two best languages are less than
    ``spec.ambiguous`` apart. Columns of those names are replaced, all others stay.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = with_fields(docs, "lang_pred string, score double, ambiguous boolean")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in portions(batches, at, 4_000_000):
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = batch.column(at).to_pylist()
                legible = [i for i, t in enumerate(texts) if model and t and (_LETTER.search(t) or any(map(str.isalpha, t)))]
                names, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), [False] * len(texts)
                if legible:
                    best, top, second = decode(model, features([texts[i].encode() for i in legible]))
                    for i, b, a, c in zip(legible, best, top, second):
                        names[i], score[i], unsure[i] = model.languages[b], min(1.0, float(a)), bool(a - c < spec.ambiguous)
                added = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return in_tasks(spread_rows(docs, "text"), task, schema)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from; the rest is held out."""
    return docs.where(remainder(F.col("doc_id"), 4) != 2)
