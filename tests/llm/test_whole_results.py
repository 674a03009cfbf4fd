"""Rows, links and letters that earlier versions lost."""

from collections import Counter

import corpus_pipeline
import pytest

from varve.llm import capfilter, huffman, langmix, toxic

TEXT = " ".join(f"word{i}" for i in range(120))
NEAR = TEXT.replace("word60 ", "other ")
OTHER = "a wholly different text of other words that nobody has linked with anything yet " + "x y z w v " * 9


def left(spark, rows):
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, key int")
    return Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect())


def test_rows_of_one_id_are_judged_apart(spark):
    assert left(spark, [(1, TEXT), (2, NEAR), (2, OTHER), (3, "few"), (3, "words")]) == Counter([(2, NEAR), (2, OTHER), (3, "few"), (3, "words")])


@pytest.mark.parametrize("rows, n", [([(None, TEXT)] * 3 + [(None, OTHER), (None, None), (None, "")], 4), ([(-5, TEXT), (5, TEXT), (5, TEXT)], 1), ([(7, OTHER)] * 4 + [(8, None)] * 2, 3), ([], 0)])
def test_one_row_of_each_group_stays(spark, rows, n):
    got = left(spark, rows)
    assert sum(got.values()) == n and set(got) <= set(rows)


def test_vectors_of_every_length_and_scale_link(spark):
    rows = [(1, [1.0, 0.0]), (2, [1e-200, 0.0]), (3, [1e200, 1e190]), (4, [2.0, 0.1]), (5, [1.0, 2.0, 3.0]), (6, [2.0, 4.0, 6.0]), (7, [0.0, 0.0, 0.0]), (8, []), (9, [5.0]), (10, [-5.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (0, 9), 10: (0, 10)}


@pytest.mark.parametrize("text, letters", [("½ ² Ⅷ", ""), ("①②", ""), ("a½b", " a b "), ("x² é", " x é "), ("12 !", "")])
def test_only_letters_are_letters(text, letters):
    assert langmix.plain(text) == letters


def test_every_letter_of_a_long_word_counts():
    word = "abcdefghij" * 7 + "q"
    parts = toxic.words_of(word)
    assert "".join(parts) == word and all((toxic.word_grams([p]) >= 0).sum() == len(p) for p in parts)


def test_training_sample_is_the_same_for_any_layout(spark):
    docs = spark.createDataFrame([(1, "b text"), (1, "a text"), (1, "c text"), (2, "d text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    got = [toxic.training_sample(docs.repartition(n), labels)[0] for n in (1, 2, 4)]
    assert got[0] == got[1] == got[2] and "b text" not in got[0]


def test_written_ids_are_read_from_the_files_alone(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string")
    huffman.write_tokens(docs, str(tmp_path / "out"), public_tokenizers.path("word_bpe_49k.json"), 2)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"chunks", "code"}
    assert huffman.read_tokens(spark.newSession(), str(tmp_path / "out")).count() == 20
