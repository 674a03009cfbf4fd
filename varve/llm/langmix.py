"""Language identification by mixture inference: each text is a mixture of languages over its n-grams.

Expectation-maximisation estimates the proportions of the learned languages from the likelihoods of
the text's character n-grams; nested sets of the strongest languages are compared by likelihood less
a penalty for each further language, and the text is in the languages of the best set.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from varve.llm.common import hash32, sealed
from varve.llm.toxic import is_held_out, text_steps
from varve.session import ship

SAMPLE_DOCS = 2000
SLOTS = 1 << 14
PRIOR = 0.1
UNKNOWN = "und"
# characters of a text that count as evidence at full weight; neighbouring n-grams are not independent
EVIDENCE = 0.2
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-case words with single blanks around them; empty if there is no letter."""
    words = _NO_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if words and not words.replace(" ", "").isalpha():  # numerals that are neither digits nor letters
        words = " ".join("".join(c if c.isalpha() else " " for c in words).split())
    return f" {words} " if words else ""


def gram_counts(words: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots and counts of all character trigrams of a plain text."""
    raw = np.frombuffer(words.encode("utf-32-le"), "<u4").astype(np.uint32)
    slot = (raw[:-2] * np.uint32(2654435761) ^ raw[1:-1] * np.uint32(2246822519) ^ raw[2:] * np.uint32(3266489917)) * np.uint32(668265263) >> np.uint32(18)
    n = np.bincount(slot, minlength=SLOTS)
    at = np.flatnonzero(n)
    return at, n[at]


def _em(odds: np.ndarray, n: np.ndarray, weight: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions over the columns of ``odds`` and the log likelihood they reach."""
    total = n.sum()
    for _ in range(rounds):
        last, weight = weight, weight * ((n / (odds @ weight)) @ odds) / total
        if np.abs(weight - last).max() < 1e-4:
            break
    return weight, float(n @ np.log(odds @ weight))


def infer(words: str, model: dict, rounds: int = 30) -> tuple[str, float, dict[str, float]]:
    """Main language, its proportion among the chosen set, and the proportions of the set."""
    names, table = model["names"], model["likelihood"]
    if not words or not names:
        return UNKNOWN, 0.0, {}
    at, n = gram_counts(words)
    logs = model["log"][at]
    n = n * EVIDENCE
    alone = n @ logs
    if len(names) == 1:
        return names[0], 1.0, {names[0]: 1.0}
    odds = table[at]
    odds = odds / odds.max(axis=1, keepdims=True)
    shift = float(n @ np.log(table[at].max(axis=1)))
    full, _ = _em(odds, n, np.full(len(names), 1 / len(names)), rounds)
    order = np.argsort(-full, kind="stable")
    top = int(alone.argmax())
    penalty = 0.5 * np.log(max(2.0, n.sum()))
    best, chosen, share = float(alone[top]), [top], np.ones(1)
    for k in range(2, len(names) + 1):
        members = order[:k]
        if full[members[-1]] < 1e-3:
            break
        start = full[members] / full[members].sum()
        weight, likely = _em(odds[:, members], n, start, rounds)
        if likely + shift - (k - 1) * penalty <= best:
            break
        best, chosen, share = likely + shift - (k - 1) * penalty, list(members), weight
    first = int(np.argmax(share))
    if len(chosen) == 1:
        # how sure one language alone is, against its rivals alone
        odds_alone = np.exp(np.clip(alone - alone[top], -700, 0))
        score = float(1 / odds_alone.sum())
    else:
        score = float(share[first])
    return names[chosen[first]], min(1.0, max(0.0, score)), {names[c]: float(s) for c, s in zip(chosen, share)}


def learn(docs: DataFrame, bound: int = SAMPLE_DOCS) -> dict:
    """n-gram likelihoods of every language with usable rows.

    Rows that are not held out and have a language teach; of a language with more than ``bound`` of
    them about that many, chosen by hash. Their whole texts are counted on the executors, and only
    sums by (language, slot), SLOTS x languages numbers, reach the driver.
    """
    spark = ship(docs.sparkSession)
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    have = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = have.select("lang", (F.least(F.lit(1.0), F.lit(float(bound)) / F.col("n")) * (1 << 32)).cast("long").alias("upto"))
    # one row per language
    rows = usable.join(F.broadcast(part), "lang").filter(hash32(F.lit("lang"), F.col("doc_id")) < F.col("upto")).select("lang", "text")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for begin, end in text_steps(batch.column(1)):
                for lang, text in zip(batch.column(0).slice(begin, end - begin).to_pylist(), batch.column(1).slice(begin, end - begin).to_pylist()):
                    words = plain(text)
                    if words:
                        at, n = gram_counts(words)
                        total.setdefault(lang, np.zeros(SLOTS, np.int64))[at] += n
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "slot", "n"])

    sums = rows.mapInArrow(run, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    for r in sums.toLocalIterator():
        counts.setdefault(r.lang, np.zeros(SLOTS))[r.slot] = r.n
    names = sorted(counts)
    if not names:
        return {"names": [], "likelihood": np.zeros((SLOTS, 0)), "log": np.zeros((SLOTS, 0))}
    table = np.stack([counts[x] for x in names], axis=1) + PRIOR
    table /= table.sum(axis=0)
    return {"names": names, "likelihood": table, "log": np.log(table)}


def identify(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with lang, score and mix (language to proportion) of every whole text.

    A null text or one without a letter is ``und`` with score 0 and an empty mixture, as is every
    text if nothing was learned. Of the columns, which may have any names, only ``text`` is read;
    repeated rows are kept. No rows give no rows.
    """
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(model["likelihood"].tobytes()))  # SLOTS x languages
    names, rows = model["names"], sealed(docs, F.col("text").alias("text"), keep=keep)
    told = [("lang", pa.string(), StringType()), ("score", pa.float64(), DoubleType()), ("mix", pa.map_(pa.string(), pa.float64()), MapType(StringType(), DoubleType()))]

    def run(batches):
        table = np.frombuffer(zlib.decompress(packed.value)).reshape(SLOTS, len(names))
        own = {"names": names, "likelihood": table, "log": np.log(table)}
        for batch in batches:
            texts, found = batch.column(1), []
            for begin, end in text_steps(texts):
                found += [infer(plain(t), own) for t in texts.slice(begin, end - begin).to_pylist()]
            cells = [[f[0] for f in found], [f[1] for f in found], [list(f[2].items()) for f in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t[1]) for c, t in zip(cells, told)]], ["row", *[t[0] for t in told]])

    return rows.mapInArrow(run, StructType([rows.schema["row"], *[StructField(t[0], t[2]) for t in told]]))
