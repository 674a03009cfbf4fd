"""Set similarity join of documents on word n-grams, by prefix trees.

Documents become sets of 64-bit hashes of their distinct word n-grams. Two sets with Jaccard >= t can
only link if t of each set's own n-grams occur in another document, so a first pass over all n-grams
counts, for every document, how many do; few documents remain. Theirs are put in one global order,
by document frequency. By the prefix principle linked sets share one of their rarest n-grams, so sets
that share none are never compared: each connected block of such sets is stored in a trie, most
frequent n-grams first, and every set walks down the trie once, counting overlaps along shared paths
and leaving subtrees whose remaining lengths cannot reach the threshold, or whose sets it is already
connected with.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import HASH_RANGE, hash32
from varve.llm.components import components
from varve.session import checkpointed, ship

WORDS = 5
PERCENT = 80
CHUNK = 2048
BROADCAST_ROWS = 200_000
_FLUSH_BYTES, _STEP_BYTES, _FLUSH_DOCS, _MANY = 16 << 20, 2 << 20, 60_000, 0xFFFF
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct n-grams of UTF-8 texts, in order of (hash, document).

    Words are runs of bytes that are not ASCII white space, A-Z in lower case; a text with fewer than
    ``WORDS`` words has its whole sequence, one with none has nothing.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin = edge[~space[edge]]
    if len(raw) and not space[0]:
        begin = np.concatenate([[0], begin])
    end = edge[space[edge]]
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # a word's hash is its polynomial, cut from running sums over the whole run of bytes
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), dtype=np.uint64)])
    word = mixed((run[end] - run[begin]) * _powers(_INVERSE, len(raw) + 1)[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(np.cumsum(size + 1), begin, "right")
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    words = np.diff(first)
    gram, left = word.copy(), len(word)
    place = np.arange(left) - first[doc]
    longest = np.minimum(words[doc] - place, WORDS)
    for i in range(1, WORDS):
        more = longest > i
        at = np.flatnonzero(more)
        gram[at] = gram[at] * np.uint64(0xD6E8FEB86659FD93) + word[at + i]
    gram = mixed(gram + np.minimum(words[doc], WORDS).astype(np.uint64))
    keep = (longest == WORDS) | ((words[doc] < WORDS) & (place == 0))
    gram, doc = gram[keep], doc[keep]
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
    return gram[fresh], doc[fresh]


def _batch_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of many texts, hashed in steps that bound the memory."""
    found, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= _STEP_BYTES or i + 1 == len(texts):
            h, d = shingle_sets(texts[begin : i + 1])
            found.append((h, d + begin))
            begin, size = i + 1, 0
    h, d = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(h, kind="stable")
    return h[order], d[order]


# --- first pass: how many of a document's n-grams occur in others ---------------------------------

_PARCEL = "bucket int, batch bigint, kind int, a binary, b binary"
_RETURN = "batch bigint, bucket int, kind int, a binary, b binary"


def _rows(cells: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "batch": pa.int64(), "kind": pa.int32(), "a": pa.binary(), "b": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*cells), names)], names)


def _flushed(batches):
    """(batch number, columns of rows) in runs of bounded bytes and rows; the last column is the text."""
    from pyspark import TaskContext

    number, held, size = TaskContext.get().partitionId() << 20, [], 0
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            text = (row[-1] or "").encode()
            held.append((*row[:-1], text))
            size += len(text)
            if size >= _FLUSH_BYTES or len(held) >= _FLUSH_DOCS:
                yield number, held
                number, held, size = number + 1, [], 0
    if held:
        yield number, held


def _prints(h: np.ndarray, d: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each document's set and two sums that tell sets apart; equal sets add up in equal order."""
    high, low = (mixed(h) >> np.uint64(11)).astype(np.float64), (mixed(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(11)).astype(np.float64)
    return np.bincount(d, minlength=docs), np.bincount(d, high, docs), np.bincount(d, low, docs)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in hashes in ascending order."""
    number = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(number, np.arange(buckets + 1))


def _send_prints(buckets: int):
    """Batches of documents as parcels by hash bucket. An n-gram that several documents of the batch hold
    is known to be shared and sent once, so the most frequent n-grams cost a parcel one entry."""

    def run(batches):
        for number, rows in _flushed(batches):
            h, d = _batch_sets([r[-1] for r in rows])
            n, one, two = _prints(h, d, len(rows))
            start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            many = np.diff(np.r_[start, len(h)]) > 1
            shared = np.bincount(d[np.repeat(many, np.diff(np.r_[start, len(h)]))], minlength=len(rows)) if len(h) else np.zeros(len(rows), np.int64)
            prints, owner = (h[start] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.where(many, _MANY, d[start]).astype("<u2")
            cuts = _buckets(h[start], buckets)
            cells = [(b, number, 0, prints[x:y].tobytes(), owner[x:y].tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
            ids = np.array([r[0] for r in rows], "<i8")
            told = n.astype("<i8").tobytes() + shared.astype("<i8").tobytes() + one.astype("<f8").tobytes() + two.astype("<f8").tobytes()
            cells.append((number * 7919 % buckets, number, 1, ids.tobytes(), told))
            for cell in cells:
                yield _rows([cell], ["bucket", "batch", "kind", "a", "b"])

    return run


def _count_prints(table: pa.Table) -> pa.Table:
    """Per batch, which of its documents have n-grams of this bucket that other batches hold too, and how many."""
    rows = list(zip(*[table.column(c).to_pylist() for c in ("batch", "bucket", "kind", "a", "b")]))
    out = [r for r in rows if r[2] == 1]
    parcels = [r for r in rows if r[2] == 0]
    if parcels:
        prints = [np.frombuffer(r[3], "<u4") for r in parcels]
        every = np.concatenate(prints)
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        shared = np.zeros(len(every), bool)
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        at = 0
        for r, own in zip(parcels, prints):
            owner = np.frombuffer(r[4], "<u2")[shared[at : at + len(own)]]
            at += len(own)
            who, n = np.unique(owner[owner != _MANY], return_counts=True)
            if len(who):
                out.append((r[0], r[1], 0, who.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
    names = ["batch", "bucket", "kind", "a", "b"]
    return pa.Table.from_batches([_rows(out, names)]) if out else pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))})


def _sum_prints(table: pa.Table) -> pa.Table:
    rows = list(zip(*[table.column(c).to_pylist() for c in ("kind", "a", "b")]))
    ids, told = next((a, b) for kind, a, b in rows if kind == 1)
    ids = np.frombuffer(ids, "<i8")
    n, shared, one, two = (np.frombuffer(told[8 * i * len(ids) : 8 * (i + 1) * len(ids)], t) for i, t in enumerate(("<i8", "<i8", "<f8", "<f8")))
    shared = shared.copy()
    for kind, a, b in rows:
        if kind == 0:
            shared[np.frombuffer(a, "<u2")] += np.frombuffer(b, "<u4")
    return pa.table({"doc_id": ids, "n": n, "shared": shared, "one": one, "two": two})


def shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, n, shared, one, two): set size, n-grams that another row may hold (never too few), set prints."""
    ship(docs.sparkSession)
    parcels = docs.select("doc_id", "text").mapInArrow(_send_prints(buckets), _PARCEL)
    counted = parcels.groupBy("bucket").applyInArrow(_count_prints, _RETURN)
    return counted.groupBy("batch").applyInArrow(_sum_prints, "doc_id bigint, n bigint, shared bigint, one double, two double")


# --- second pass: sets in global order ------------------------------------------------------------


def _send_sets(buckets: int):
    """Sets of candidates as parcels by hash bucket; rows whose set is not the one that was asked for are left out."""

    def run(batches):
        for number, rows in _flushed(batches):
            h, d = _batch_sets([r[-1] for r in rows])
            n, one, two = _prints(h, d, len(rows))
            right = np.array([(int(a), b, c) == (r[1], r[2], r[3]) for a, b, c, r in zip(n, one, two, rows)])
            h, d = h[right[d]], d[right[d]]
            cuts = _buckets(h, buckets)
            cells = [(b, number, 0, h[x:y].astype("<u8").tobytes(), b"") for b, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
            ids = np.array([r[0] for r in rows], "<i8")
            cells.append((number * 7919 % buckets, number, 1, ids.tobytes() + n.astype("<i8").tobytes(), d.astype("<u4").tobytes()))
            for cell in cells:
                yield _rows([cell], ["bucket", "batch", "kind", "a", "b"])

    return run


def _count_sets(table: pa.Table) -> pa.Table:
    """The document frequency of every n-gram of every parcel, in the parcel's order."""
    rows = list(zip(*[table.column(c).to_pylist() for c in ("batch", "bucket", "kind", "a", "b")]))
    out = [r for r in rows if r[2] == 1]
    parcels = [r for r in rows if r[2] == 0]
    if parcels:
        sets = [np.frombuffer(r[3], "<u8") for r in parcels]
        _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        frequency, at = count[back].astype("<u4"), 0
        for r, own in zip(parcels, sets):
            out.append((r[0], r[1], 0, r[3], frequency[at : at + len(own)].tobytes()))
            at += len(own)
    return pa.Table.from_batches([_rows(out, ["batch", "bucket", "kind", "a", "b"])])


def _order_sets(table: pa.Table) -> pa.Table:
    """Each candidate's shared n-grams, rarest first, and the prefix of them of which linked sets share one."""
    rows = sorted(zip(*[table.column(c).to_pylist() for c in ("bucket", "kind", "a", "b")]))
    parcels = [r for r in rows if r[1] == 0]
    ids, d = next((a, b) for _, kind, a, b in rows if kind == 1)
    ids, n = np.split(np.frombuffer(ids, "<i8"), 2)
    d = np.frombuffer(d, "<u4").astype(np.int64)
    h = np.concatenate([np.frombuffer(r[2], "<u8") for r in parcels] or [np.zeros(0, "<u8")])
    frequency = np.concatenate([np.frombuffer(r[3], "<u4") for r in parcels] or [np.zeros(0, "<u4")])
    h, d, frequency = h[frequency > 1], d[frequency > 1], frequency[frequency > 1]
    order = np.lexsort((h, frequency, d))
    h, d, frequency = h[order], d[order], frequency[order]
    ends = np.searchsorted(d, np.arange(len(ids) + 1))
    out = []
    for i in range(len(ids)):
        k, need = int(ends[i + 1] - ends[i]), (PERCENT * int(n[i]) + 99) // 100
        if n[i] and k >= need:
            own = slice(ends[i], ends[i + 1])
            out.append((int(ids[i]), int(n[i]), h[own].tobytes(), frequency[own].tobytes(), h[own][: k - need + 1].view("<i8")))
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "grams": pa.binary(), "frequency": pa.binary(), "prefix": pa.list_(pa.int64())}
    return pa.table({name: pa.array([o[i] for o in out], t) for i, (name, t) in enumerate(kinds.items())})


# --- the trie -------------------------------------------------------------------------------------


class _Node:
    """A run of tokens below its parent; shortest and longest full path below, least full set size, leaves, common component."""

    __slots__ = ("tokens", "depth", "children", "leaves", "least", "longest", "component")

    def __init__(self, tokens, depth):
        self.tokens, self.depth, self.children, self.leaves = tokens, depth, {}, []
        self.least, self.longest, self.component = 1 << 60, 0, None


class Trie:
    """Sets as token arrays in ascending order of one global rank; finds links between different components."""

    def __init__(self, vocabulary: int):
        self.root, self.mask, self.parent = _Node(np.zeros(0, np.int64), 0), np.zeros(vocabulary, bool), []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def insert(self, i: int, tokens: np.ndarray, n: int) -> None:
        node, at = self.root, 0
        self._pass(node, i, len(tokens), n)
        while at < len(tokens):
            child = node.children.get(int(tokens[at]))
            if child is None:
                new = _Node(tokens[at:], len(tokens))
                node.children[int(tokens[at])] = new
                self._pass(new, i, len(tokens), n)
                new.leaves.append((i, n))
                return
            rest = tokens[at : at + len(child.tokens)]
            differ = np.flatnonzero(child.tokens[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(child.tokens):
                upper = _Node(child.tokens[:same], child.depth - len(child.tokens) + same)
                upper.least, upper.longest, upper.component = child.least, child.longest, child.component
                child.tokens = child.tokens[same:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(tokens[at])] = child = upper
            node, at = child, at + same
            self._pass(node, i, len(tokens), n)
        node.leaves.append((i, n))

    def _pass(self, node: _Node, i: int, length: int, n: int) -> None:
        if node.longest == 0 and node.least == 1 << 60:
            node.component = i
        elif node.component is not None and self.find(node.component) != self.find(i):
            node.component = None
        node.least, node.longest = min(node.least, n), max(node.longest, length)

    def search(self, i: int, tokens: np.ndarray, n: int) -> None:
        """Link set i with sets in the trie that it is not yet connected with."""
        self.mask[tokens] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.component is not None and self.find(node.component) == self.find(i):
                continue
            if len(node.tokens):
                overlap += int(np.count_nonzero(self.mask[node.tokens]))
            for j, m in node.leaves:
                if 100 * overlap >= PERCENT * (n + m - overlap) and self.find(j) != self.find(i):
                    self.links.append((j, i))
                    self.parent[max(self.find(j), self.find(i))] = min(self.find(j), self.find(i))
            if not node.children:
                continue
            # of the set, only tokens behind the node's last can still match
            left = len(tokens) - int(np.searchsorted(tokens, node.tokens[-1], "right")) if len(node.tokens) else len(tokens)
            for child in node.children.values():
                most = overlap + min(left, child.longest - node.depth)
                if 100 * most >= PERCENT * (n + child.least - most):
                    stack.append((child, overlap))
        self.mask[tokens] = False


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links that connect the sets of a block, or of two chunks of it."""
    grams = [np.frombuffer(b, "<u8") for b in pdf["grams"]]
    size = np.fromiter(map(len, grams), np.int64, len(grams))
    every = np.concatenate(grams)
    frequency = np.concatenate([np.frombuffer(b, "<u4") for b in pdf["frequency"]]).astype(np.int64)
    _, first, back = np.unique(every, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.lexsort((every[first], -frequency[first]))] = np.arange(len(first))  # most frequent first
    tokens = [np.sort(t) for t in np.split(rank[back], np.cumsum(size)[:-1])]
    n, ids, chunk = pdf["n"].to_numpy(), pdf["doc_id"].to_numpy(), pdf["chunk"].to_numpy()
    left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
    trie = Trie(len(first))
    trie.parent = list(range(len(ids)))
    order = np.lexsort((ids, n))
    for i in order:
        if chunk[i] == left:
            if left == right:
                trie.search(int(i), tokens[i], int(n[i]))
            trie.insert(int(i), tokens[i], int(n[i]))
    if left != right:
        for i in order:
            if chunk[i] == right:
                trie.search(int(i), tokens[i], int(n[i]))
    a, b = np.array(trie.links or np.zeros((0, 2)), np.int64).T
    return pd.DataFrame({"a": ids[a], "b": ids[b]})


def linked_sets(sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all linked sets, from ordered sets (doc_id, n, grams, frequency, prefix).

    A block of more than CHUNK sets is cut by hash into chunks, and its pairs of chunks are tasks of
    their own, so no task holds more than two chunks.
    """
    routes = checkpointed(sets.select("doc_id", F.explode("prefix").alias("gram")))
    least = routes.groupBy("gram").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = components(routes.join(least, "gram").select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    placed = sets.drop("prefix").join(blocks.select(F.col("node").alias("doc_id"), F.col("component").alias("block")), "doc_id")
    sizes = blocks.groupBy(F.col("component").alias("block")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cut = placed.join(sizes, "block").withColumn("chunk", F.floor(hash32("doc_id") * F.col("chunks") / F.lit(HASH_RANGE)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("left"), F.greatest(c, F.col("chunk")).alias("right")))
    dealt = cut.select("*", F.explode(pairs).alias("p")).select("block", "p.left", "p.right", "chunk", "doc_id", "n", "grams", "frequency")
    return dealt.groupBy("block", "left", "right").applyInPandas(_link, "a bigint, b bigint")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links, itself included) of every row.

    Rows of equal sets are one set, which its least doc_id stands for. Null and empty texts have no
    n-grams and link with nothing. Rows with a null doc_id are compared with nothing and get a null
    component; repeated rows are repeated in the result; of rows that share a doc_id but not a text
    each keeps its set, and what links with any of them is connected. No rows give no rows; other
    columns are ignored. Sets are compared by 64-bit hashes of their n-grams.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    counted = checkpointed(shared_counts(named, buckets))
    classes = counted.filter("n > 0").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.max("shared").alias("shared"))
    wanted = checkpointed(classes.filter(100 * F.col("shared") >= PERCENT * F.col("n")).select(F.col("rep").alias("doc_id"), "n", "one", "two"))
    few = wanted.count() <= BROADCAST_ROWS  # 32 bytes a row
    again = named.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "n", "one", "two", "text")
    parcels = again.mapInArrow(_send_sets(buckets), _PARCEL)
    sets = checkpointed(parcels.groupBy("bucket").applyInArrow(_count_sets, _RETURN).groupBy("batch").applyInArrow(_order_sets, "doc_id bigint, n bigint, grams binary, frequency binary, prefix array<bigint>"))
    found = linked_sets(sets)
    # rows of one doc_id belong together, whatever their texts
    own = classes.select("n", "one", "two", "rep")
    rows = counted.join(own, ["n", "one", "two"], "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    doubled = rows.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    grouped = components(found.unionByName(doubled.filter("low != high").select(F.col("low").alias("a"), F.col("high").alias("b"))))
    out = rows.join(grouped, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    nameless = shared_counts(docs.filter("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text"), buckets)
    null = F.lit(None).cast("long")
    return out.unionByName(nameless.select(null.alias("doc_id"), F.col("n").alias("n_shingles"), null.alias("component_id")))
