"""Token alignment: groups, links and counts against sets of byte places over the plain tokenizers."""

import dataclasses
import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clusterlens.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The characters that stand for bytes in the JSON vocabulary: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


BYTES = byte_of()


def bytes_a(token):
    return bytes(BYTES[c] for c in A.id_to_token(token))


def bytes_b(token):
    piece = B.id_to_piece(token)
    return bytes([int(piece[3:-1], 16)]) if B.is_byte(token) else piece.replace("▁", " ").encode()


def places(ids, width):
    spans, at = [], 0
    for token in ids:
        spans.append((at, at + len(width(token))))
        at = spans[-1][1]
    return spans


def brute(rows):
    """Rows of the contract, from sets of ends and the overlap of every pair of tokens."""
    found, held = [], Counter()
    for doc_id, text in rows:
        ids_a, ids_b = A.encode(" " + (text or ""), add_special_tokens=False).ids, B.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(bytes_a, ids_a)) != whole or b"".join(map(bytes_b, ids_b)) != whole:
            found.append((doc_id, [], [], [], []))
            continue
        spans_a, spans_b = places(ids_a, bytes_a), places(ids_b, bytes_b)
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            sides = [
                ",".join(str(token) for token, (_, end) in zip(ids, spans, strict=True) if low < end <= high)
                for ids, spans in ((ids_a, spans_a), (ids_b, spans_b))
            ]
            groups.append("|".join(sides))
        links = [
            (a, b)
            for a, (s, e) in zip(ids_a, spans_a, strict=True)
            for b, (u, v) in zip(ids_b, spans_b, strict=True)
            if s < v and u < e
        ]
        held.update(set(links))
        found.append((doc_id, ids_a, ids_b, groups, links))
    highest = Counter()
    for (a, _), n in held.items():
        highest[a] = max(highest[a], n)
    return [
        (
            doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "",
        )
        for doc_id, ids_a, ids_b, groups, links in found
    ]


UNUSUAL = [
    (1, "hello world, hello  worlds"), (2, ""), (3, None), (4, "  two  spaces \n\n\ttab  "), (5, "<|endoftext|> <s> <unk> <0x41>"),
    (6, "漢字 🙂 don't étranger ﬁne"), (7, "a▁b"), (8, "a" * 700), (9, " "), (None, "no id"), (1, "hello world"), (10, "x\0y　z"),
    (11, "​﻿"), (12, " leading"), (13, "trailing "), (14, "----" * 40), (15, "1234567890 3.14"),
]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(found):
    return sorted((tuple(row[c] for c in COLUMNS) for row in found.collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()
    return [*UNUSUAL, *((100 + r.doc_id, r.text[:1500]) for r in texts)]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT_PAIRS, 300, 0])
def test_against_brute_force(spark, docs, frequent):
    """All pairs broadcast, some of them, and none."""
    frame = spark.createDataFrame([(d, t, "x", 7) for d, t in docs], "doc_id long, text string, codes string, row_id int")
    assert rows_of(alignment.alignment(frame, frequent_pairs=frequent)) == sorted(brute(docs), key=str)


def loaded():
    return alignment.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model"))


def whole(text, t):
    """The text as one window."""
    ids_a, ids_b = alignment.encoded(text, t)
    [window] = alignment.align_windows([(*ids_a.tolist(), -1, *ids_b.tolist())], t)
    return window


def check(found, text, t):
    groups, n_groups, codes = whole(text, t)
    assert (found.groups, found.n_groups, found.n_links) == (groups, n_groups, len(codes) // 4)
    pairs = dict(zip(found.codes.tolist(), found.times.tolist(), strict=True))
    assert pairs == Counter(np.frombuffer(codes, np.int32).tolist())


def test_windows_and_batches_do_not_matter(monkeypatch):
    """Texts aligned together in windows, and each as one window; also where all windows meet by a useless hash."""
    t, pick = loaded(), random.Random(2)
    pieces = ["ab", " ", "  ", "the ", "é", "漢", "\n", "un", "1", "ing ", "'s", "▂", "▁"]
    texts = ["".join(pick.choice(pieces[: 12 + (n % 9 == 0)]) for _ in range(30)) for n in range(200)] + ["", None, "the"]
    for mix in (alignment._MIX, np.zeros_like(alignment._MIX)):
        monkeypatch.setattr(alignment, "_MIX", mix)
        memo = alignment.Memo(40)
        for size in (len(texts), 7, 1):
            for at in range(0, len(texts), size):
                for text, found in zip(texts[at : at + size], alignment.align(texts[at : at + size], t, memo), strict=True):
                    if text and "▁" not in text:
                        check(found, text, t)
                    else:
                        assert found.n_a == found.n_groups == found.n_links == 0 and not found.groups


def test_the_byte_tables_are_those_of_the_vocabularies():
    t = loaded()
    with open(public_tokenizers.path("byte_bpe_50k.json")) as lines:
        vocabulary = json.load(lines)["model"]["vocab"]
    assert all(t.bytes_a[i] == bytes(BYTES[c] for c in token) for token, i in vocabulary.items() if token != "<|endoftext|>")
    assert all(t.bytes_b[i] == bytes_b(i) for i in range(B.get_piece_size()))


def test_memo_is_bounded_and_keeps_what_is_met_again():
    t, memo = loaded(), alignment.Memo(3)
    for text in ("one two three four five six seven", "one two one nine one ten one eleven one", "one"):
        check(alignment.align([text], t, memo)[0], text, t)
        assert len(memo.young) <= 3 and len(memo.old) <= 3
    assert any(t.bytes_a[key[0]] == b" one" for key in memo.young)


def test_long_texts_and_empty_tables(spark):
    rows = [(1, "a" * 300_000), (2, " " * 300_000), (3, "漢" * 60_000), (4, "word " * 60_000)]
    found = alignment.token_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_groups > 0 and r.n_links == r.n_a + r.n_b - r.n_groups == sum(r.times) for r in found)
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert rows_of(alignment.alignment(nothing)) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_the_query(spark):
    found = queries.op12_alignment(spark, "/root/testdata/sf0.001")
    assert tuple(found.columns) == COLUMNS and found.count() == 200
    assert found.where("n_a > 0 AND (n_best > n_links OR count_sum < n_links)").count() == 0


def test_words_are_encoded_once_and_follow_one_another():
    t, memo, read = loaded(), alignment.Memo(), []
    counted = dataclasses.replace(t, encode_a=lambda text: read.append(len(text)) or t.encode_a(text))
    text = "The naïve cat's 12 hats, and the cat's  hats\n and\x1cthe cat 猫 — it's <0x41>"
    texts = [text, text * 3, f"{text} {text}", f" {text}", f"{text} ", f"{text} ▁ x", "a  b", "x", "퟿ 1 2", None, ""]
    first = alignment.align(texts, counted, memo)
    for one, other in zip(first, alignment.align_whole(texts, t, alignment.Memo()), strict=True):
        assert (one.n_a, one.n_b, one.n_groups, one.n_links, one.groups) == (other.n_a, other.n_b, other.n_groups, other.n_links, other.groups)
        assert one.codes.tolist() == other.codes.tolist() and one.times.tolist() == other.times.tolist()
    read.clear()
    alignment.align([f"{text} {text}"] * 50, counted, memo)
    assert sum(read) < len(text)
