"""Pipelined search against a plain count of every term in every document."""

import math
import random
import re

import pytest

from ledgerloom.llm import ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, all_terms = sum(map(bool, terms)), sum(map(len, terms))
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    for i, want in wanted.items():
        rows = []
        for (d, _), t in zip(docs, terms, strict=True):
            if d is None or not t:
                continue
            m, score = 10 + 90 * len(t) * n_docs // all_terms, 0
            for w in want & set(t):
                tf = t.count(w)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                rows.append((-score, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    return sorted(tuple(r) for r in ranked_search.search(d, q, k).collect())


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["Ähre", "ñu", "É", "中文", "a1"]
    text = lambda: "".join(w + rng.choice([" ", "-", "\n", "._", "é"]) for w in rng.choices(vocabulary, [1 / (i + 1) for i in range(65)], k=rng.randint(1, 40)))
    docs = [(i, text()) for i in range(n)]
    docs += [(2**60 + 1, docs[0][1]), (2**60 + 2, docs[0][1]), (None, docs[0][1]), docs[1], (n + 5, None), (n + 6, ""), (n + 7, "--- ..")]
    docs += [(n + 8, "w59 " * 30_000)]
    items = [(i, text()) for i in range(25)] + [(3, "w59 w58"), (None, "w1"), (90, None), (91, "!"), (92, "nowhere"), (2**60, "W7 w7 w59")]
    return docs, items


@pytest.mark.parametrize("size", [(128, 500_000), (4, 7)], ids=["one owner each", "many owners and bundles"])
def test_search_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(ranked_search, "ITEMS", size[0])
    monkeypatch.setattr(ranked_search, "OWNED", size[1])
    docs, items = corpus(random.Random(7), 300)
    got = found(spark, docs, items)
    assert got == brute(docs, items, 10)
    assert {r[2] for r in got if r[0] == 2**60} & {308}


def test_search_with_ties_and_few_documents(spark):
    docs = [(i, "same text") for i in (5, 3, 9, 3)] + [(1, "other")]
    assert found(spark, docs, [(1, "text"), (2, "other text")], 3) == brute(docs, [(1, "text"), (2, "other text")], 3)
    assert found(spark, [], [(1, "a")]) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], [(1, "a")]) == []
