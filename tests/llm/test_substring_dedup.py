"""Substring dedup against a scan in the order of ids."""

import random

import pytest

from clusterlens.llm import queries, substring_dedup
from clusterlens.llm.substring_dedup import run_hashes, sentences, without


def brute(rows):
    """Texts left, for rows without repeated ids."""
    seen, left = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        repeated = []
        for at, value in enumerate(run_hashes(text or "")):
            if value is not None:
                if value in seen:
                    repeated.append(at)
                seen.add(value)
        left[doc_id] = None if text is None else without(text, repeated)[0]
    return left


def test_sentences_cover_the_text():
    pick = random.Random(1)
    for _ in range(300):
        text = "".join(pick.choice(["a", "bc ", ". ", "! ", "\n", "\n\n", " ", "e.g.", "é", "word " * 9]) for _ in range(40))
        spans = sentences(text)
        assert "".join(text[a:b] for a, b in spans) == text
    assert sentences("") == [] and len(sentences("One two. Three!\nfour")) == 3
    assert len(sentences("w " * 160)) == 10


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_against_a_scan(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = queries.op8_substring_dedup(spark, f"/root/testdata/{size}").collect()
    assert {r.doc_id: r.text for r in found} == brute(rows)
    assert any(r.n_removed for r in found)


PASSAGE = "Here begins a passage of some length. It goes on for a while without saying much. Then it ends, as it must."


def test_a_passage_stays_once(spark):
    rows = [(n, f"Text number {n} has an opening of its own. {PASSAGE} And number {n} closes in its own words.") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "length(text) AS n_chars", "1 AS at", "2 AS cut_id")
    found = substring_dedup.drop_repeats(docs)
    assert found.columns == docs.columns
    texts = {r.doc_id: r for r in found.collect()}
    assert [n for n, r in texts.items() if "goes on for a while" in r.text] == [0]
    assert all(f"number {n}" in r.text.lower() and r.n_chars == len(r.text) for n, r in texts.items())


def test_one_endless_sentence(spark):
    words = " ".join(f"w{n}" for n in range(60))
    rows = [(1, words), (2, "Before. " + words), (3, "other words only")]
    found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {1: words, 2: "Before. ", 3: "other words only"}


def test_unusual_rows(spark):
    rows = [(2, PASSAGE), (1, PASSAGE.upper()), (None, PASSAGE), (3, None), (4, ""), (5, "short. short."), (1, PASSAGE.upper()), (6, "la la la la la. " * 5_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS run", "'y' AS _hash2")
    found = sorted(((r.doc_id, r.text) for r in substring_dedup.drop_repeats(docs).collect()), key=str)
    assert len(found) == len(rows)
    assert found.count((1, PASSAGE.upper())) == 2  # a repeated row is the same document
    assert {(2, ""), (None, ""), (3, None), (4, ""), (5, "short. short.")} <= set(found)
    assert [len(t) for d, t in found if d == 6] == [len("la la la la la. ")]
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_a_passage_of_short_lines_is_found(spark, size):
    lines = "\n".join(" ".join(f"v{n}x{k}" for k in range(size)) for n in range(80 // size))
    rows = [(n, f"Opening words of {n}.\n{lines}\nClosing words of {n}.") for n in range(3)]
    found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {n: rows[0][1] if n == 0 else f"Opening words of {n}.\nClosing words of {n}." for n in range(3)}


def test_no_short_sentence_stays_behind_in_an_exact_repeat(spark):
    pick = random.Random(4)
    lengths = [14, 3, 2, 4, 15, 2, 1, 3, 12, 1, 1]
    passage = " ".join(" ".join(f"p{n}q{pick.randrange(10**6)}" for _ in range(k)) + "." for n, k in enumerate(lengths))
    rows = [(1, passage), (2, f"Private words. {passage} Private end.")]
    found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {1: passage, 2: "Private words. Private end."}


def test_scripts_without_spaces(spark):
    pick = random.Random(6)
    han = ["".join(chr(0x4E00 + pick.randrange(8000)) for _ in range(k)) + "。" for k in (15, 12, 9, 14, 40, 11)]
    passage = "".join(han)
    rows = [(1, passage), (2, "我的話。" + passage + "再見。"), (3, "短句子在此。短句子在此。")]
    found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in found} == {1: passage, 2: "我的話。再見。", 3: rows[2][1]}


def test_a_passage_without_sentence_ends_at_unequal_offsets(spark):
    """60 shared words after 5, 9, 20 and 33 private ones: little more than the words before the first common cut stays."""
    pick = random.Random(7)
    stays = []
    for trial in range(25):
        shared = [f"s{pick.randrange(10**6)}" for _ in range(60)]
        offsets = enumerate((5, 9, 20, 33))
        rows = [(4 * trial + n, " ".join([*(f"own{n}x{pick.randrange(10**6)}" for _ in range(k)), *shared, *(f"end{n}x{k}x{trial}" for k in range(7))])) for n, k in offsets]
        texts = brute(rows)
        assert texts[rows[0][0]] == rows[0][1]
        stays += [sum(w in set(shared) for w in texts[d].split()) for d, _ in rows[1:]]
        if trial == 0:
            found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert {r.doc_id: r.text for r in found} == texts
    assert sum(stays) / len(stays) < 20 and sum(s < 60 for s in stays) >= 0.98 * len(stays)


def plainly(rows):
    """The same from the definition alone, for texts of short lines that end in a period: no function of the library."""
    seen, left = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.splitlines(keepends=True)
        words = [line.lower().split() for line in lines]

        def enough(i, j, words=words):
            return j - i >= 2 and sum(map(len, words[i:j])) >= 10

        n = len(lines)
        from_each = {(i, min(j for j in range(i, n + 1) if enough(i, j))) for i in range(n) if enough(i, n)}
        up_to_each = {(max(i for i in range(j) if enough(i, j)), j) for j in range(1, n + 1) if enough(0, j)}
        gone = set()
        for i, j in sorted(from_each | up_to_each):
            run = " ".join(word for line in words[i:j] for word in line)
            if run in seen:
                gone.update(range(i, j))
            seen.add(run)
        left[doc_id] = "".join(line for k, line in enumerate(lines) if k not in gone)
    return left


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_the_definition(spark, seed):
    pick = random.Random(seed)
    pool = [" ".join(pick.choice(["Red", "blue", "green", "old", "new"]) for _ in range(pick.choice([1, 2, 4, 7, 12]))) + ".\n" for _ in range(25)]
    rows = [(n, "".join(pick.choice(pool) for _ in range(pick.randrange(0, 14)))) for n in range(120)]
    expected = plainly(rows)
    found = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == expected
    assert sum(len(text) for _, text in rows) > sum(map(len, expected.values())) > 0
