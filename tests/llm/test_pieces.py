"""SentencePiece segmentation against brute force, and exact round trips."""

import random
import time

import public_tokenizers
import pytest

from clusterlens.llm import pieces, queries
from clusterlens.llm.pieces import SPACE

VOCABULARY = pieces.vocabulary(public_tokenizers.path(pieces.MODEL))
SURFACES = pieces.surfaces(public_tokenizers.path(pieces.MODEL))


def every_segmentation(text):
    text = SPACE + text.replace(" ", SPACE)
    found = []

    def extend(at, score, ids):
        if at == len(text):
            found.append((score, b"".join(ids)))
            return
        for end in range(at + 1, min(len(text), at + 16) + 1):
            piece = text[at:end]
            if piece in VOCABULARY.pieces:
                gain, known = VOCABULARY.pieces[piece]
                extend(end, score + gain, [*ids, known])
            elif end == at + 1:
                extend(end, score + VOCABULARY.unknown, [*ids, VOCABULARY.spelled(piece)])

    extend(0, 0, [])
    return sorted(found, reverse=True)


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_against_brute_force(n):
    pick = random.Random(n)
    for _ in range(250):
        text = "".join(pick.choice("abeth insér\n,.漢  ") for _ in range(pick.randint(1, 9)))
        best, found = every_segmentation(text), VOCABULARY.encode(text, n)
        assert [score for score, _ in found] == [score for score, _ in best[:n]]
        assert len({ids for _, ids in found}) == len(found)
        assert all(one in best for one in found)
        assert all(SURFACES.decode(ids) == text for _, ids in found)


@pytest.mark.parametrize("n", [2, 5])
@pytest.mark.parametrize("character", ["-", " ", "a", "x", "漢", "=", "▂"])
def test_runs_of_one_character_against_brute_force(character, n):
    """Runs have many segmentations of equal score."""
    for size in range(1, 12):
        best, found = every_segmentation(character * size), VOCABULARY.encode(character * size, n)
        assert [score for score, _ in found] == [score for score, _ in best[:n]]
        assert len({ids for _, ids in found}) == len(found) and all(one in best for one in found)


@pytest.mark.parametrize("n", [2, 8])
@pytest.mark.parametrize("text", ["-" * 10_000, " " * 10_000, "a" * 200_000, "漢" * 200_000, "x" * 1_600, "ab" * 5_000, "- " * 4_000])
def test_long_runs_end(text, n):
    begun = time.monotonic()
    found = VOCABULARY.encode(text, n)
    assert time.monotonic() - begun < 20
    assert all(SURFACES.decode(ids) == text for _, ids in found)
    assert [score for score, _ in found] == sorted([score for score, _ in found], reverse=True)


def test_a_long_text_without_spaces():
    text = "the" * 20_000
    [(score, ids)] = VOCABULARY.encode(text, 1)
    assert SURFACES.decode(ids) == text and score < 0


def test_rows(spark):
    rows = [(1, "Hello  world\nfoo"), (2, ""), (3, None), (None, "é 漢"), (1, "Hello  world\nfoo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS score", "2 AS rank")
    decoded = pieces.decode(pieces.encode(docs, n=2)).collect()
    assert sorted((str(r.doc_id), r.rank, r.text) for r in decoded) == sorted(
        [(str(d), k, t or "") for d, t in rows for k in (1, 2) if t or k == 1]
    )
    assert pieces.encode(docs.limit(0)).count() == 0


def test_the_query_reads_every_text_back(spark):
    rows = queries.op7_sentencepiece(spark, "/root/testdata/sf0.001")
    assert rows.where("rank = 1").count() == 200
    assert rows.where("NOT round_trip").count() == 0
