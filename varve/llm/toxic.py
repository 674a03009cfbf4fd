"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input joins a learned vector of its hash, the mean of learned vectors of its character
trigrams, and how strongly the word itself speaks for a label in the training sample. Texts are read
in overlapping windows, one from each word on; a text's score is that of its worst window.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from varve.llm.common import hash32, sealed
from varve.session import ship

TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_CHARS = 1000, 2000, 10_000
KNOWN_TEXTS, DROPOUT = 3, 0.7
WINDOW, STRIDE = 16, 1  # every window of a text is read
THRESHOLD = 0.7  # fixed by the contract
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 8
WORD_SLOTS, CHAR_SLOTS = 1 << 14, 1 << 12
CACHED_WORDS = 200_000
_GRAMS, _LANES, _TEXT_STEP = 20, 4096, 1 << 20
_WORD = re.compile(rf"[^\W\d_]{{1,{_GRAMS}}}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; one of more than _GRAMS letters is several words, so that all its letters are read."""
    return _WORD.findall(text.lower()) if text else []


def window_starts(n: int) -> np.ndarray:
    """Starts of windows that cover n words with WINDOW - STRIDE words of overlap; the last ends at the last word."""
    return np.minimum(np.arange(max(1, -(-(n - WINDOW) // STRIDE) + 1)) * STRIDE, max(0, n - WINDOW))


def word_grams(words: list[str]) -> np.ndarray:
    """Slots of all character trigrams of each word of up to _GRAMS letters with its borders (-1: none)."""
    size = np.fromiter(map(len, words), np.int64, len(words))  # a word of n letters has n trigrams
    raw = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
    begin = np.cumsum(size + 2) - (size + 2)
    k = np.arange(_GRAMS)
    there = k < size[:, None]
    at = np.where(there, begin[:, None] + k, 0)
    code = raw[at] * 961 + raw[at + 1] * 31 + raw[at + 2] if len(raw) else at
    return np.where(there, code * 2654435761 % (1 << 32) * CHAR_SLOTS >> 32, -1).astype(np.int16)


def leaning(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Signed root of the likelihood ratio statistic of a word's counts against the labels' shares, scaled to -2..3; 0 if unseen."""
    toxic, clean = np.maximum(toxic, 0), np.maximum(clean, 0)
    both, share = toxic + clean, n_toxic / max(1, n_toxic + n_clean)
    part = lambda n, expected: n * np.log(np.maximum(n, 1e-9) / np.maximum(expected, 1e-9))
    root = np.sqrt(np.maximum(2 * (part(toxic, both * share) + part(clean, both * (1 - share))), 0))
    return np.clip(np.where(toxic > both * share, root, -root) / 4, -2, 3).astype(np.float32)


# --- the network --------------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def new_network(rng: np.random.Generator) -> dict[str, np.ndarray]:
    d, h = 1 + WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = {"words": draw(WORD_SLOTS, WORD_DIM, scale=0.01), "chars": draw(CHAR_SLOTS, CHAR_DIM, scale=0.01), "attend": draw(2 * h, scale=0.1), "out": draw(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32)}
    for way in "fb":
        net |= {f"wx{way}": draw(d, 3 * h, scale=0.5), f"bx{way}": np.zeros(3 * h, np.float32), f"uh{way}": draw(h, 3 * h, scale=h**-0.5)}
    return net


def _run_gru(inputs, u, steps, keep=None):
    """States after each step; inputs(t) gives the projected inputs (lanes, 3 * HIDDEN) of update, reset, new."""
    h, out = HIDDEN, []
    state = None
    for t in steps:
        x = inputs(t)
        if state is None:
            state = np.zeros((len(x), h), np.float32)
        from_state = state @ u
        gates = _sigmoid(x[:, : 2 * h] + from_state[:, : 2 * h])
        new = np.tanh(x[:, 2 * h :] + gates[:, h:] * from_state[:, 2 * h :])
        before, state = state, new + gates[:, :h] * (state - new)
        out.append(state)
        if keep is not None:
            keep.append((before, gates, new, from_state[:, 2 * h :]))
    return out


def _pooled(states: np.ndarray, attend: np.ndarray):
    weight = states @ attend
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    return weight, (weight[..., None] * states).sum(axis=0)


# 1 / (1 + exp(-x)) is the logistic function, 1 - 2 / (1 + exp(2 * x)) the hyperbolic tangent
_EXPONENT = np.repeat(np.float32([-1, 2]), (2 * HIDDEN, HIDDEN))


def _heads_of_states(x_at, u: np.ndarray, heads: np.ndarray, steps, lanes: int) -> np.ndarray:
    """Products of the states with ``heads`` (HIDDEN, 2) at each step, (2, WINDOW, lanes); no state is kept.

    Lanes run along the last axis. ``x_at(t)`` and ``u`` come times _EXPONENT, so that one exponential gives a gate or a new state.
    """
    h = HIDDEN
    weights = np.ascontiguousarray(np.concatenate([u, heads], axis=1).T)
    out, state, from_state = np.empty((2, WINDOW, lanes), np.float32), np.zeros((h, lanes), np.float32), np.zeros((3 * h + 2, lanes), np.float32)
    gates, before = np.empty((2 * h, lanes), np.float32), None
    for t in steps:
        if before is not None:
            np.matmul(weights, state, out=from_state)
            out[:, before] = from_state[3 * h :]
        x = x_at(t)
        np.add(x[: 2 * h], from_state[: 2 * h], out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = from_state[2 * h : 3 * h]
        new *= gates[h:]
        new += x[2 * h :]
        np.exp(new, out=new)
        new += 1
        np.divide(-2, new, out=new)
        new += 1
        state -= new
        state *= gates[:h]
        state += new
        before = t
    out[:, before] = heads.T @ state
    return out


def score_windows(ids: np.ndarray, starts: np.ndarray, table: np.ndarray, net: dict) -> np.ndarray:
    """Probability of the window of WINDOW words at each of the ascending ``starts`` in the stream of words ``ids``.

    ``ids`` are rows of ``table``, whose rows are both projections of a word. Lanes that follow each other
    read slices of the stream; what memory is used depends on ``_LANES``, not on the stream.
    """
    h = HIDDEN
    weights = [net[k] * _EXPONENT for k in ("uhf", "uhb")]
    heads = [np.stack([net["attend"][a : a + h], net["out"][a : a + h]], axis=1) for a in (0, h)]
    scores = np.empty(len(starts), np.float32)
    for at in range(0, len(starts), _LANES):
        lanes = starts[at : at + _LANES] - starts[at]
        x = np.ascontiguousarray((table[ids[starts[at] : starts[at] + lanes[-1] + WINDOW]] * np.tile(_EXPONENT, 2)).T)
        span = int(lanes[-1]) + 1
        # a few windows over the border of two texts cost less than gathering words at each step
        joined = span <= 1.4 * len(lanes)
        read = (lambda rows: lambda t: rows[:, t : t + span]) if joined else (lambda rows: lambda t: rows.take(lanes + t, axis=1))
        n = span if joined else len(lanes)
        with np.errstate(over="ignore"):  # an infinite exponential is a gate of 0 or a new state of 1
            ahead = _heads_of_states(read(x[: 3 * h]), weights[0], heads[0], range(WINDOW), n)
            ahead += _heads_of_states(read(x[3 * h :]), weights[1], heads[1], range(WINDOW - 1, -1, -1), n)
        weight = np.exp(ahead[0] - ahead[0].max(axis=0))
        score = _sigmoid((weight * ahead[1]).sum(axis=0) / weight.sum(axis=0) + net["bias"])
        scores[at : at + _LANES] = score[lanes] if joined else score
    return scores


def windows_of(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stream of the words of all documents, starts of their windows in it, first window of each document); none may be empty."""
    docs = [np.resize(d, WINDOW) if len(d) < WINDOW else d for d in docs]  # short texts repeat to fill a window
    size = np.array([len(d) for d in docs], np.int64)
    own = [window_starts(n) for n in size]
    first = np.cumsum([0, *map(len, own)])[:-1]
    return np.concatenate(docs), np.concatenate([s + b for s, b in zip(own, np.cumsum(size) - size)]), first


def word_inputs(net: dict, slots: np.ndarray, grams: np.ndarray, lean: np.ndarray) -> np.ndarray:
    there = grams >= 0
    chars = (net["chars"][grams] * there[..., None]).sum(axis=-2) / np.maximum(there.sum(axis=-1), 1)[..., None]
    return np.concatenate([lean[..., None], net["words"][slots], chars], axis=-1).astype(np.float32)


def projected(net: dict, inputs: np.ndarray) -> np.ndarray:
    return np.concatenate([inputs @ net["wxf"] + net["bxf"], inputs @ net["wxb"] + net["bxb"]], axis=-1).astype(np.float32)


def projected_words(net: dict, slots: np.ndarray, grams: np.ndarray, lean: np.ndarray, step: int = 8192) -> np.ndarray:
    """Both projections of each word of a vocabulary; trigram vectors are gathered for ``step`` words at a time."""
    cuts = [slice(a, a + step) for a in range(0, len(slots), step)]
    parts = [projected(net, word_inputs(net, slots[c], grams[c], lean[c].astype(np.float32))) for c in cuts]
    return np.concatenate([np.zeros((0, 6 * HIDDEN), np.float32), *parts])


def _gru_gradient(kept, u, dstates, order):
    """Back through time: gradients of the projected inputs by step, and of u."""
    h, du = HIDDEN, np.zeros_like(u)
    dx, carry = {}, 0
    for t, (before, gates, new, pre) in zip(reversed(order), reversed(kept)):
        d = dstates[t] + carry
        update, reset = gates[:, :h], gates[:, h:]
        dnew = d * (1 - update) * (1 - new * new)
        dupdate = d * (before - new) * update * (1 - update)
        dreset = dnew * pre * reset * (1 - reset)
        dx[t] = np.concatenate([dupdate, dreset, dnew], axis=1)
        dfrom = np.concatenate([dupdate, dreset, dnew * reset], axis=1)
        du += before.T @ dfrom
        carry = d * update + dfrom @ u.T
    return dx, du


def _gradients(net, slots, grams, lean, label, weight):
    """Weighted log loss of a batch of windows (arrays (lanes, length, ...)) and the gradient of every parameter."""
    h, n = HIDDEN, slots.shape[1]
    inputs = word_inputs(net, slots, grams, lean)
    proj = projected(net, inputs).transpose(1, 0, 2)
    keep_f, keep_b, ahead, back = [], [], list(range(n)), list(range(n - 1, -1, -1))
    hf = _run_gru(lambda t: proj[t, :, : 3 * h], net["uhf"], ahead, keep_f)
    hb = _run_gru(lambda t: proj[t, :, 3 * h :], net["uhb"], back, keep_b)[::-1]
    states = np.concatenate([np.stack(hf), np.stack(hb)], axis=2)
    share, pooled = _pooled(states, net["attend"])
    p = _sigmoid(pooled @ net["out"] + net["bias"])
    dlogit = ((p - label) * weight / weight.sum()).astype(np.float32)
    grad = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
    dpooled = dlogit[:, None] * net["out"]
    dshare = (states * dpooled).sum(axis=2)
    dscore = share * (dshare - (share * dshare).sum(axis=0))
    grad["attend"] = np.einsum("tl,tlh->h", dscore, states)
    dstates = share[..., None] * dpooled + dscore[..., None] * net["attend"]
    dxf, grad["uhf"] = _gru_gradient(keep_f, net["uhf"], dstates[..., :h], ahead)
    dxb, grad["uhb"] = _gru_gradient(keep_b, net["uhb"], dstates[..., h:], back)
    dproj = {"f": np.stack([dxf[t] for t in range(n)], axis=1), "b": np.stack([dxb[t] for t in range(n)], axis=1)}
    dinputs, flat = 0, inputs.reshape(-1, inputs.shape[-1])
    for way in "fb":
        d = dproj[way].reshape(-1, 3 * h)
        grad |= {f"wx{way}": flat.T @ d, f"bx{way}": d.sum(axis=0)}
        dinputs = dinputs + d @ net[f"wx{way}"].T
    grad["words"] = np.zeros_like(net["words"])
    np.add.at(grad["words"], slots.reshape(-1), dinputs[:, 1 : 1 + WORD_DIM])
    there = grams >= 0
    dchars = (dinputs[:, 1 + WORD_DIM :] / np.maximum(there.sum(axis=-1), 1).reshape(-1, 1)).astype(np.float32)
    rows, cols = np.nonzero(there.reshape(-1, _GRAMS))
    grad["chars"] = np.zeros_like(net["chars"])
    np.add.at(grad["chars"], grams.reshape(-1, _GRAMS)[rows, cols], dchars[rows])
    loss = -(weight * np.log(np.where(label > 0, p, 1 - p) + 1e-7)).sum() / weight.sum()
    return loss, grad


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 3, epochs: int = 4, seed: int = 7) -> dict:
    """Train on whole labelled texts. A toxic text teaches by its worst window only, which the network picks anew each round;
    clean texts teach by their worst windows and by windows at random."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
    keep = [i for i, d in enumerate(ids) if len(d)]
    ids, toxic = [ids[i] for i in keep], np.asarray(toxic, bool)[keep]
    count = np.zeros((2, max(1, len(vocabulary))), np.int64)
    for d, t in zip(ids, toxic):
        count[int(t), np.unique(d)] += 1
    n = np.array([(~toxic).sum(), toxic.sum()])
    names = list(vocabulary)
    known = count.sum(axis=0) >= KNOWN_TEXTS
    slots = np.array([zlib.crc32(w.encode()) % (WORD_SLOTS - 1) + 1 if k else 0 for w, k in zip(names, known)], np.int64)
    lean_all = leaning(count[1], count[0], n[1], n[0]) * known
    model = {"net": new_network(rng), "words": {names[i]: (int(slots[i]), float(lean_all[i])) for i in np.flatnonzero(known[: len(names)])}}
    if not len(ids):
        return model
    net, grams = model["net"], word_grams(names)
    # a word's leaning while training leaves out the text at hand
    held = [leaning(count[1] - 1, count[0], n[1] - 1, n[0]) * known, leaning(count[1], count[0] - 1, n[1], n[0] - 1) * known]
    stream, starts, first = windows_of(ids)
    owner = np.repeat(np.arange(len(ids)), np.diff(np.r_[first, len(starts)]))
    bad = toxic[owner]
    word_bad = np.repeat(toxic, [max(len(d), WINDOW) for d in ids])
    stream_lean = np.where(word_bad, held[0][stream], held[1][stream]).astype(np.float32)
    score = _two_highest(stream_lean, starts)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items()}
    step = 0
    for r in range(rounds):
        best = first + np.array([score[a:b].argmax() for a, b in zip(first, np.r_[first[1:], len(owner)])])
        positive, worst = best[toxic[owner[best]]], best[~toxic[owner[best]]]
        spare = np.flatnonzero(~bad)
        chosen = np.concatenate([positive, worst, rng.choice(spare, min(len(spare), 2 * len(best)), replace=False)])
        label = bad[chosen].astype(np.float32)
        weight = np.where(label > 0, 1 / max(1, label.sum()), 1 / max(1, (1 - label).sum())).astype(np.float32) * len(chosen)
        for _ in range(max(epochs, 240 * 128 // (rounds * max(1, len(chosen))))):
            for at in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // 128)):
                pick = starts[chosen[at]][:, None] + np.arange(WINDOW)
                words = stream[pick]
                # learned vectors of most words are hidden, so that a small sample is not learnt by heart
                hidden = rng.random(words.shape) < DROPOUT
                spelt = np.where(hidden[..., None], -1, grams[words])
                _, grad = _gradients(net, np.where(hidden, 0, slots[words]), spelt, stream_lean[pick], label[at], weight[at])
                step += 1
                for k, g in grad.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    rate = 0.001 if k in ("words", "chars") else 0.01
                    net[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                    net[k] *= 1 - 0.1 * rate
        if r < rounds - 1:
            # rows of toxic texts' words, then those of clean ones: their leanings differ
            table = np.concatenate([projected_words(net, slots, grams, side) for side in held])
            score = score_windows(stream + np.where(word_bad, 0, len(names)), starts, table, net)
    return model


def _two_highest(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the two highest values of each window."""
    steps = [starts[a : a + _LANES, None] + np.arange(WINDOW) for a in range(0, len(starts), _LANES)]
    return np.concatenate([np.partition(values[s], WINDOW - 2, axis=1)[:, -2:].sum(axis=1) for s in steps])


# --- scoring whole texts ------------------------------------------------------------------------


class Scorer(dict):
    """Scores texts; keeps the projected input of words it has met, ``CACHED_WORDS`` about at most."""

    def __init__(self, model: dict):
        super().__init__()
        self.net, self.known, self.fresh = model["net"], model["words"], []
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.fresh.append(word)
        return at

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
            self.table = self.table[:0]
        docs = [np.fromiter(map(self.__getitem__, words_of(t)), np.int64) for t in texts]
        if self.fresh:
            slots, lean = np.array([self.known.get(w, (0, 0.0)) for w in self.fresh]).T
            self.table = np.concatenate([self.table, projected_words(self.net, slots.astype(np.int64), word_grams(self.fresh), lean)])
            self.fresh = []
        out = np.zeros(len(texts))
        filled = [i for i, d in enumerate(docs) if len(d)]
        if filled:
            stream, starts, first = windows_of([docs[i] for i in filled])
            out[filled] = np.maximum.reduceat(score_windows(stream, starts, self.table, self.net), first)
        return out


def text_steps(texts: pa.Array, step: int = _TEXT_STEP):
    """(begin, end) of runs of about ``step`` characters, whatever the batch holds."""
    size, begin = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0))), 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + step, "right")))
        yield begin, end
        begin = end


def is_held_out(doc_id: str = "doc_id"):
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3) == 1


def training_sample(docs: DataFrame, labels: DataFrame, toxic_bound: int = TOXIC_SAMPLE, clean_bound: int = CLEAN_SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most about the bounds' numbers of labelled documents that are not held out, chosen by hash.

    Texts over SAMPLE_CHARS characters do not teach (all are scored). Of several labels of a document
    the highest counts, of several texts the least; a null label is none.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    bound = {1: toxic_bound, 0: clean_bound}
    have = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r.toxic in bound}
    ranges = {k: int((1 << 32) * min(1.0, bound[k] / n)) for k, n in have.items()}
    chosen = usable.filter(_any([(F.col("toxic") == k) & (hash32(F.lit("toxic"), F.col("doc_id")) < v) for k, v in ranges.items()]))
    # the chosen ids number toxic_bound + clean_bound about at most, so they may be broadcast
    rows = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    got = rows.toPandas().sort_values("doc_id")
    return got["text"].tolist(), got["toxic"].to_numpy(dtype=np.int64)


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def score_texts(docs: DataFrame, model: dict, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` as struct ``row`` with ``score`` (0 to 1): the highest of all overlapping windows of the whole text.

    A text without letters, empty or null scores 0. Repeated rows are kept; of the columns, which may
    have any names, only ``text`` is read. No rows give no rows.
    """
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the sample
    rows = sealed(docs, F.col("text").alias("text"), keep=keep)

    def run(batches):
        scorer = Scorer(pickle.loads(packed.value))
        for batch in batches:
            texts = batch.column(1)
            parts = [scorer.scores(texts.slice(b, e - b).to_pylist()) for b, e in text_steps(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["row", "score"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))
