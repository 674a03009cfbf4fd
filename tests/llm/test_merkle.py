"""Merkle manifests against a plain tree over all leaves."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from varve.llm import merkle

KIND = "doc_id long, text string, lang string, row string, tree int, pos long, digest string, changed int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proof(tree, i):
    out = []
    for level in tree[:-1]:
        first = i - i % 8
        out.append((level[first:i], level[i + 1 : first + 8]))
        i //= 8
    return out


def expected(rows, change):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of each row; ``change`` maps a text or gives None."""
    own = defaultdict(list)
    code = lambda *v: H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in v])
    for doc_id, text, lang in rows:
        new = change(doc_id, text)
        own[lang].append((doc_id is not None, doc_id or 0, code(doc_id, lang, text), code(doc_id, lang, new[0]) if new else None))
    langs = sorted(own, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels([x[2] for x in sorted(own[k], key=lambda x: x[:3])]) for k in langs}
    top = levels([trees[k][-1][0] for k in langs]) if langs else None
    out = []
    for k, lang in enumerate(langs):
        for i, (named, doc_id, leaf, changed) in enumerate(sorted(own[lang], key=lambda x: x[:3])):
            path, now = proof(trees[lang], i) + proof(top, k), changed or leaf
            for left, right in path:
                now = H(*left, now, *right)
            out.append((doc_id if named else None, leaf, trees[lang][-1][0], top[-1][0], H(*[x for a, b in path for x in a + b]), now, now == top[-1][0]))
    return Counter(out)


def built(spark, rows, changed=None):
    df = spark.createDataFrame([(*r, "x", 3, 4, "y", 5) for r in rows], KIND).repartition(3)
    out = merkle.manifest(df, merkle.record_hash("doc_id", "lang", "text"), F.col("lang"), "doc_id", changed)
    return Counter(tuple(r) for r in out.select("row.doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, None: 1}, {"en": 9, "": 2, "é": 64, None: 65}, {f"l{i}": 1 + i for i in range(11)}])
def test_manifest_against_a_plain_tree(spark, sizes):
    rows = [(i * 7 % 1000, f"Text {i} of {lang}" if i % 5 else None, lang) for lang, n in sizes.items() for i in range(n)]
    change = lambda d, t: (t.lower(),) if t and d % 3 == 0 else None
    assert built(spark, rows, F.when(F.col("doc_id") % 3 == 0, merkle.record_hash("doc_id", "lang", F.lower("text")))) == expected(rows, change)


def test_more_leaves_than_a_block_with_repeats_and_nulls(spark):
    rows = [(i, "same" if i % 3 else "Other", "en") for i in range(1200)] + [(5, "same", "en")] * 600 + [(None, "x", "en"), (None, None, None), (3, "", "fr")]
    change = lambda d, t: ("bad",) if d == 700 else None
    got = built(spark, rows, F.when(F.col("doc_id") == 700, merkle.record_hash("doc_id", "lang", F.lit("bad"))))
    assert got == expected(rows, change)
    assert sum(n for r, n in got.items() if not r[-1]) == 1


def test_manifest_without_rows(spark):
    assert built(spark, []) == Counter()


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 65, 512])
def test_folding_resumes_kept_states(n):
    digests = [H(str(i)) for i in range(n)]
    tree = merkle.Subtree(digests, merkle.levels_above(n))
    for i in range(0, n, 5):
        changed = [*digests[:i], H("new"), *digests[i + 1 :]]
        assert [tree.fold(i, H("new"))] == levels(changed)[-1] and [tree.fold(i, digests[i])] == tree.top
    # a path's states have taken the left siblings in already: folding needs the right ones alone
    path = merkle.Path(";".join(f"{a.decode()}|{b.decode()}" for a, b in tree.siblings(n // 2)))
    assert [path.fold(digests[n // 2])] == tree.top and len(path.proof) == 64 * sum(len(a) + len(b) for a, b in proof(levels(digests), n // 2))
