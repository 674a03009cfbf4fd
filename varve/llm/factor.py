"""Quality: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of inputs interacts through the product of two low-rank vectors; a text is scored in time
linear in its inputs, as the sum over pairs is half of (square of sums - sum of squares) by factor.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from varve.llm.common import hash32, sealed
from varve.session import ship

SAMPLE = 2500  # labelled documents of each label that teach, about
THRESHOLD = 0.3  # fixed by the contract
SLOTS, FACTORS = 1 << 14, 8
EPOCHS, BATCH, RATE, DECAY, HIDE = 20, 64, 0.02, 2e-3, 0.3
CACHED_WORDS = 200_000
_TEXT_STEP = 1 << 20

_BYTE_CLASSES = np.zeros((256, 7), np.int64)
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (32, 9, 11, 12, 13), (10,), range(0x80, 0xC0), [b for b in range(33, 127) if not chr(b).isalnum()])):
    _BYTE_CLASSES[list(_bytes), _k] = 1
_PUNCTUATION = [ord(c) for c in ".,;:!?$#&*%@<>/\\{}()[]=_|~^+-'\""]
STATISTICS = 15 + len(_PUNCTUATION)


class Words(dict):
    """Slot of each word; emptied beyond ``CACHED_WORDS``, which changes nothing but time."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        at = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % SLOTS
        return at


def word_inputs(texts: list[str | None], slots: Words) -> tuple[np.ndarray, ...]:
    """(text, slot, value) of all words of whole texts, values of a text of length 1; number of words, of distinct slots and of words like the one before by text."""
    words = [(t or "").split() for t in texts]
    size = np.fromiter(map(len, words), np.int64, len(texts))
    slot = np.fromiter((slots[w] for ws in words for w in ws), np.int64, int(size.sum()))
    coded = np.repeat(np.arange(len(texts)), size) * SLOTS + slot
    again = np.bincount(coded[1:][coded[1:] == coded[:-1]] // SLOTS, minlength=len(texts))
    key, n = np.unique(coded, return_counts=True)
    owner, value = key // SLOTS, np.log1p(n)
    norm = np.sqrt(np.bincount(owner, value * value, len(texts)))
    return owner, key % SLOTS, value / norm[owner], size, np.bincount(owner, minlength=len(texts)), again


def statistics(text: str | None, n_words: int, distinct: int, again: int, n_chars: int | None) -> list[float]:
    """Shares of kinds of bytes, lengths, repeated words and lines, and the recorded length against the real one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    total = max(1, len(raw))
    upper, lower, digits, blanks, breaks, inner, marks = (counts @ _BYTE_CLASSES).tolist()
    lines = (text or "").split("\n")
    recorded, chars = n_chars or 0, len(text or "")
    own = [
        upper / max(1, upper + lower), digits / total, blanks / total, breaks / total, inner / total, marks / total,
        np.log1p(total), np.log1p(n_words), chars / max(1, n_words), distinct / max(1, n_words),
        len(set(lines)) / len(lines), np.log1p(total / len(lines)), np.log1p(recorded), abs(np.log1p(recorded) - np.log1p(chars)), again / max(1, n_words),
    ]
    return own + np.sqrt(counts[_PUNCTUATION] / max(1, n_words)).tolist()


def logits(model: dict, owner: np.ndarray, slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Bias, linear part and all pairwise interactions of each of n texts, whose inputs lie in order of ``owner``."""
    out = np.full(n, model["bias"], np.float64)
    if not len(owner):
        return out
    first = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
    who = owner[first]
    out[who] += np.add.reduceat(model["linear"][slot] * value, first)
    scaled = model["factors"][slot] * value[:, None]
    sums = np.add.reduceat(scaled, first, axis=0)
    out[who] += 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, first, axis=0)).sum(axis=1)
    return out


def standardised(model: dict, stats: np.ndarray) -> np.ndarray:
    return np.clip((stats - model["mean"]) / model["spread"], -4, 4) / np.sqrt(STATISTICS)


def with_statistics(owner: np.ndarray, slot: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs of words and of standardised statistics together, in order of text."""
    n = len(stats)
    owner = np.r_[owner, np.repeat(np.arange(n), STATISTICS)]
    order = np.argsort(owner, kind="stable")
    return owner[order], np.r_[slot, np.tile(SLOTS + np.arange(STATISTICS), n)][order], np.r_[value, stats.ravel()][order]


def new_model(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    n = SLOTS + STATISTICS
    return {"bias": 0.0, "linear": np.zeros(n), "factors": rng.standard_normal((n, FACTORS)) * 0.05, "mean": np.zeros(STATISTICS), "spread": np.full(STATISTICS, np.inf)}


def fit(examples: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> dict:
    """Train by mini-batches (Adam) on (slots, values, statistics) of each text; both labels weigh the same.

    Without examples of both labels all texts score 0.5.
    """
    model, rng = new_model(seed), np.random.default_rng(seed)
    labels = np.asarray(labels, np.float64)
    if not 0 < labels.sum() < len(labels):
        return model | {"factors": np.zeros_like(model["factors"])}
    stats = np.array([e[2] for e in examples])
    spread = stats.std(axis=0)
    model |= {"mean": stats.mean(axis=0), "spread": np.where(spread > 1e-9, spread, np.inf)}
    stats = standardised(model, stats)
    weight = np.where(labels > 0, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    moments = {k: [np.zeros_like(model[k]), np.zeros_like(model[k])] for k in ("linear", "factors")} | {"bias": [0.0, 0.0]}
    step = 0
    for _ in range(max(EPOCHS, 6000 // max(1, len(labels)))):
        for chosen in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            size = np.array([len(examples[i][0]) for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), size)
            slot, value = np.concatenate([examples[i][0] for i in chosen]), np.concatenate([examples[i][1] for i in chosen])
            seen = rng.random(len(slot)) >= HIDE  # words hidden at random, so that a small sample is not learnt by heart
            owner, slot, value = with_statistics(owner[seen], slot[seen], value[seen], stats[chosen])
            p = 1 / (1 + np.exp(-np.clip(logits(model, owner, slot, value, len(chosen)), -30, 30)))
            pull = (p - labels[chosen]) * weight[chosen] / len(chosen)
            first = np.flatnonzero(np.r_[True, np.diff(owner) > 0])
            scaled = model["factors"][slot] * value[:, None]
            sums = np.add.reduceat(scaled, first, axis=0)[np.cumsum(np.r_[0, np.diff(owner) > 0])]
            g = pull[owner] * value
            n = len(model["linear"])
            grads = {"bias": pull.sum(), "linear": np.bincount(slot, g, n) + DECAY * model["linear"]}
            grads["factors"] = np.stack([np.bincount(slot, g * (sums[:, f] - scaled[:, f]), n) for f in range(FACTORS)], axis=1) + DECAY * model["factors"]
            step += 1
            for k, d in grads.items():
                m = moments[k]
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.999 * m[1] + 0.001 * d * d
                model[k] = model[k] - RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def _steps(texts: pa.Array):
    size, begin = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + _TEXT_STEP, "right")))
        yield begin, end
        begin = end


def inputs_of(texts: list[str | None], recorded: list[int | None], slots: Words):
    """Word inputs of whole texts (owner, slot, value) and their raw statistics."""
    owner, slot, value, words, distinct, again = word_inputs(texts, slots)
    stats = np.array([statistics(*x) for x in zip(texts, words.tolist(), distinct.tolist(), again.tolist(), recorded)], np.float64).reshape(-1, STATISTICS)
    return owner, slot, value, stats


def is_held_out(doc_id: str = "doc_id") -> Column:
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5) == 0


def training_examples(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE):
    """Inputs and labels of about ``bound`` documents of each label, not held out, chosen by hash.

    Whole texts teach: tasks send the inputs of the chosen rows, at most a value for each of SLOTS
    slots of a text, never the text. Of several labels of a document the highest counts, of several
    texts the least; labels other than 0 and 1 are none.
    """
    spark = ship(docs.sparkSession)
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    have = {r.quality: r.n for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    least = F.lit(False)
    for k, n in have.items():
        least = least | ((F.col("quality") == k) & (hash32(F.lit("quality"), F.col("doc_id")) < int((1 << 32) * min(1.0, bound / n))))
    # the chosen ids number about twice the bound at most, so they may be broadcast
    chosen = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(usable.filter(least)), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("d"), F.max("quality").alias("quality")).select("doc_id", "quality", "d.text", "d.n_chars")

    def run(batches):
        slots = Words()
        for batch in batches:
            ids, label, texts, recorded = batch.columns
            for a, b in _steps(texts):
                owner, slot, value, stats = inputs_of(texts.slice(a, b - a).to_pylist(), recorded.slice(a, b - a).to_pylist(), slots)
                cut = np.searchsorted(owner, np.arange(b - a + 1))
                cells = [[pickle.dumps((slot[i:j].astype(np.int32), value[i:j].astype(np.float32), s))] for i, j, s in zip(cut, cut[1:], stats)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), label.slice(a, b - a), pa.array([c[0] for c in cells], pa.binary())], ["doc_id", "quality", "inputs"])

    kind = StructType([chosen.schema["doc_id"], chosen.schema["quality"], *spark.createDataFrame([], "inputs binary").schema])
    got = sorted(chosen.mapInArrow(run, kind).collect(), key=lambda r: r.doc_id)
    return [pickle.loads(r.inputs) for r in got], np.array([r.quality for r in got], np.int64)


def score_texts(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with ``score`` (0 to 1, higher: quality 1 likelier).

    Read are ``text``, whole and of any length, and ``n_chars`` (null: 0). Null and empty texts score by
    their statistics alone. Repeated rows are kept, other columns may have any names, no rows give none.
    """
    spark = ship(docs.sparkSession)
    packed = spark.sparkContext.broadcast(pickle.dumps(model))  # SLOTS + STATISTICS rows, whatever the data
    rows = sealed(docs, F.col("text").alias("text"), F.col("n_chars").cast("long").alias("n_chars"), keep=keep)

    def run(batches):
        known, slots = pickle.loads(packed.value), Words()
        for batch in batches:
            row, texts, recorded = batch.columns
            scores = [np.zeros(0)]
            for a, b in _steps(texts):
                owner, slot, value, stats = inputs_of(texts.slice(a, b - a).to_pylist(), recorded.slice(a, b - a).to_pylist(), slots)
                z = logits(known, *with_statistics(owner, slot, value, standardised(known, stats)), b - a)
                scores.append(1 / (1 + np.exp(-np.clip(z, -500, 500))))
            yield pa.RecordBatch.from_arrays([row, pa.array(np.concatenate(scores))], ["row", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))
