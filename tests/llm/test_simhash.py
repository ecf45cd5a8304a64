"""SimHash classes against brute force, hot groups included."""

import random

import numpy as np
import xxhash

from clusterlens.llm import simhash
from clusterlens.llm.components import connected_components


class Union:
    def __init__(self, names):
        self.parent = {n: n for n in names}

    def find(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def test_components(spark):
    pick = random.Random(5)
    edges = [(pick.randrange(400), pick.randrange(400)) for _ in range(250)]
    edges += [(n, n + 1) for n in range(1000, 1200)] + [(7, 7), (-5, 3), (3, -5)]
    union = Union({n for e in edges for n in e})
    for a, b in edges:
        union.join(a, b)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {n: union.find(n) for n in union.parent if union.find(n) != n}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_print(text, size):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = ["", " \n ", "One", "one two", "a b c", "Ä b\tc d\x0be  f", "x y z " * 9000, "a b c d e"]
    for text in texts:
        for size in (1, 3, 5):
            assert int(simhash.fingerprint(text, size)[0]) == brute_print(text, size)
    assert len(simhash.fingerprint("a b c d e f", 5, 8)) == 8


def test_links_lose_nothing_in_hot_blocks(spark):
    """Many fingerprints around one centre share every block; chains of two bits; and random ones."""
    pick = random.Random(3)
    centre = pick.getrandbits(64)
    values = {centre ^ sum(1 << b for b in pick.sample(range(64), k)) for k in (1, 2, 3, 4) for _ in range(60)}
    chain = pick.getrandbits(64)
    for at in range(0, 40, 2):
        chain ^= 3 << at
        values.add(chain)
    values |= {pick.getrandbits(64) for _ in range(200)} | {0, 1 << 63, (1 << 63) | 1}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "node long")
    edges = simhash.close_pairs(nodes).collect()
    bits = np.array(signed, dtype=np.int64)
    assert all(int(np.bitwise_count(np.uint64((a ^ b) & (2**64 - 1)))) <= 2 for a, b in edges)
    wanted, found = Union(signed), Union(signed)
    for i, value in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count((bits[i + 1 :] ^ bits[i]).view(np.uint64)) <= 2):
            wanted.join(value, signed[i + 1 + j])
    for a, b in edges:
        found.join(a, b)
    assert [found.find(v) for v in signed] == [wanted.find(v) for v in signed]


def test_classes_of_unusual_rows(spark):
    rows = [(5, "a b c d"), (3, "A B C D"), (9, None), (8, ""), (7, " \t"), (None, "a b c d"), (None, "q r s t u"), (5, "other words here now"), (11, "w " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS component_id", "3 AS text_hash")
    found = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert found == sorted([(5, 3), (3, 3), (9, 7), (8, 7), (7, 7), (None, 3), (None, None), (5, 5), (11, 11)], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0


def near_rows(seed=1):
    """Texts, copies with a few words changed, and unrelated texts: (id, text), and pairs with their similarity."""
    pick = random.Random(seed)
    words = [f"w{n}" for n in range(5000)]
    rows, bases = [], []
    for n in range(60):
        base = [pick.choice(words) for _ in range(pick.choice([120, 250, 600]))]
        bases.append(base)
        rows.append((10 * n, " ".join(base)))
        for k in range(1, 4):
            copy = base.copy()
            for at in pick.sample(range(len(copy)), max(1, len(copy) // 100)):
                copy[at] = pick.choice(words)
            rows.append((10 * n + k, " ".join(copy)))
    return rows


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_near_copies_are_found_and_others_left_alone(spark):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS source", "1 AS _gone")
    found = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    sets = {d: shingles(t) for d, t in rows}
    close = hits = 0
    for a, _ in rows:
        for b, _ in rows:
            if a < b:
                shared = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
                if shared >= 0.8:
                    close += 1
                    hits += found[a] == found[b]
                if shared < 0.5:
                    assert a // 10 == b // 10 or found[a] != found[b]
    assert close > 150 and hits >= 0.95 * close
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, c in found.items() if d == c}


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h"), (2, "something quite different from all the others"), (None, "a b c d e f g h"), (4, None)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[2], rows[3], rows[4]], key=str)


def test_a_key_with_unrelated_holders_links_all_that_are_near(spark, monkeypatch):
    """All under one key: near copies that unrelated and half-similar texts sort between; compared whole and in cells."""
    pick = random.Random(8)
    words = [f"w{n}" for n in range(5000)]
    template = [pick.choice(words) for _ in range(200)]
    rows = []
    for n in range(100):  # the first 50 are of similarity 0.5 to each other, the last 50 of none
        base = [*template, *(pick.choice(words) for _ in range(100))] if n < 50 else [pick.choice(words) for _ in range(300)]
        copy = base.copy()
        copy[pick.randrange(300)] = "changed"
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    hot = [pick.choice(words) for _ in range(300)]
    rows += [(1000 + n, " ".join([*hot[:n], "changed", *hot[n + 1 :]])) for n in range(150)]
    monkeypatch.setattr(simhash, "_key_rows", lambda nodes, words: nodes.selectExpr("7L AS key", "node"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {r.doc_id: (r.node, *r.rest) for r in simhash.fingerprints(docs, size=5, words=8, doc_id="doc_id", text="text").collect()}
    most = simhash.allowed_distance(0.8, 512)
    wanted = Union(prints)
    for a in prints:
        for b in prints:
            if a < b and sum((x ^ y).__and__(2**64 - 1).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= most:
                wanted.join(a, b)
    expected = {n: wanted.find(n) for n in prints}
    assert sum(expected[2 * n] == expected[2 * n + 1] for n in range(100)) == 100
    for holders in (simhash.COMPARED_HOLDERS if hasattr(simhash, "COMPARED_HOLDERS") else 0, 16):
        monkeypatch.setattr(simhash, "COMPARED_HOLDERS", holders, raising=False)
        assert {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()} == expected


def test_a_repeated_line_does_not_outvote_different_bodies(spark):
    pick = random.Random(9)
    line = " ".join(f"line{n}" for n in range(7))
    bodies = [" ".join(f"b{pick.randrange(10**6)}" for _ in range(100)) for _ in range(2)]
    rows = [(n, f"{body} " + f"{line} " * 100) for n, body in enumerate(bodies)]
    found = simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 1}


def test_texts_that_share_the_first_word_of_their_fingerprints_only(spark, monkeypatch):
    """The second agrees with the first in 64 bits of 512, the third in all, the fourth in all but one."""
    bits = [(5, [3] * 7), (5, [-4] * 7), (5, [3] * 7), (5, [3] * 6 + [2])]
    made = spark.createDataFrame([(n, 100 + n, *b) for n, b in enumerate(bits)], "doc_id long, text_hash long, node long, rest array<long>")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, **options: made)
    found = simhash.near_classes(made).collect()
    assert {r.doc_id: r.component_id for r in found} == {0: 0, 1: 1, 2: 0, 3: 0}
