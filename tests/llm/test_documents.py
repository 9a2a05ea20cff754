"""Operators on documents: brute force, and the odd rows of every kind."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import line_dedup, mixing, ngram_join, packing, sharding, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], SCHEMA)


def sentence(rng, n):
    return " ".join(rng.choice(["ba", "Ce", "di", "fo", "gu"]) + str(rng.randrange(4000)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows and ids, clashing names."""
    rng = random.Random(5)
    long = sentence(rng, 30_000)
    line = "x" * 45
    rows = [
        (1, None, "a"), (2, "", None), (3, " \t\n", "a"), (4, long, "b"), (5, long + " tail", "b"), (None, "no id here", None),
        (None, None, None), (6, "same text", "a"), (6, "same text", "a"), (6, "other text of the id", "c"), (7, "É é", "c"),
        *[(100 + i, f"{line}\nown line {i}", "a") for i in range(6)], (None, line, "a"),
    ]
    frame = made(spark, rows)
    for name in ("id", "size", "cls", "shard", "_row", "_q", "n_lines", "score", "copies", "word", "row", "_bucket"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs_linked(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, links


def joined(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_ngram_components_equal_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = [sentence(rng, rng.randrange(0, 120)) for _ in range(40)]
    for base in list(texts[:12]):
        for _ in range(6):  # copies with a few words changed, near the bound on either side
            w = base.split()
            for _ in range(rng.randrange(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    sets, links = pairs_linked(texts, k, percent)
    want = joined(len(texts), links)
    got = ngram_join.ngram_components(made(spark, [(i, t, "s") for i, t in enumerate(texts)]), k=k, percent=percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_ngram_components_of_odd_rows(spark, odd, empty):
    got = ngram_join.ngram_components(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[3] == {(0, 3)} and by[5] == {(by[4].copy().pop()[0] + 1, 4)} and by[7] == {(1, 7)}
    assert ngram_join.ngram_components(empty).count() == 0


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(2)
    base = sentence(rng, 200).split()
    rows = []
    for i in range(400):
        w = list(base)
        w[rng.randrange(200)] = f"edit{i}"
        rows.append((i, " ".join(w), "s"))
    got = ngram_join.ngram_components(made(spark, rows))
    assert [r["component_id"] for r in got.select("component_id").distinct().collect()] == [0]


def test_lines_are_dropped_as_counted_by_hand(spark):
    rng = random.Random(3)
    long = [("  Line %d " % i) + "y" * rng.randrange(25, 45) for i in range(12)]
    rows = []
    for i in range(60):
        lines = [rng.choice(long) if rng.random() < 0.7 else f"own {i} {j}" for j in range(rng.randrange(0, 8))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.3 else x for x in lines), "s"))
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    holders = defaultdict(set)
    for i, t, _ in rows:
        for x in t.split("\n"):
            holders[key(x)].add(i)
    want = {}
    for i, t, _ in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        want[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    out = line_dedup.dedup_lines(made(spark, rows))
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()} == want


def test_lines_of_odd_rows(spark, odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert sorted(out.columns) == sorted({*odd.columns, "n_dropped"})
    got = out.collect()
    assert len(got) == odd.count()
    kept = {r["doc_id"]: r for r in got}
    assert kept[1]["n_lines"] == 1 and kept[1]["text"] == "" and kept[105]["n_dropped"] == 0
    assert all(kept[100 + i]["text"] == f"own line {i}" for i in range(5))
    assert [r["n_dropped"] for r in got if r["doc_id"] is None and r["text"] == ""] in ([0, 1], [1, 0])
    assert line_dedup.dedup_lines(empty).count() == 0


def test_index_gives_every_key_a_slot_of_its_own():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) for _ in range(2))
    a[:50] = a[0]  # equal first halves must not hinder
    packed, sizes, slots = line_dedup.build_index(a, b)
    assert sorted(slots) == list(range(len(a)))
    assert (line_dedup.probe_index(packed, sizes, a, b) == slots).all()


def test_shards_keep_the_law(spark):
    docs = made(spark, [(i, None if i % 50 == 0 else "é" * (i % 7), "s") for i in range(4000)])
    rows = sharding.shard_documents(docs).collect()
    assert {r["law"] for r in rows} == {"key"}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(8)) and min(sizes.values()) > 400
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {8} and 300 < len(moved) < 600
    for r in rows:
        text = None if r["doc_id"] % 50 == 0 else "é" * (r["doc_id"] % 7)
        assert r["size"] == len((text or "").encode()) + 1
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))


def test_shards_are_drawn_down_the_tree(spark):
    """The same descent written out in Python, with unequal weights."""
    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 2.0), sharding.Leaf(0, 1, 2, 1.0), sharding.Leaf(1, 2, 3, 4.0)]

    def draw(level, name, weight, key):
        u = xxhash.xxh64_intdigest(f"{level}/{name}/{key}".encode(), seed=42) >> 11
        return -math.log((u + 0.5) / (1 << 53)) / weight

    def best(level, leaves, key):
        weights = Counter()
        for leaf in leaves:
            weights[getattr(leaf, level)] += leaf.weight
        name = min(weights, key=lambda n: (draw(level, n, weights[n], key), n))
        return [leaf for leaf in leaves if getattr(leaf, level) == name]

    want = {}
    for i in range(500):
        leaves = tree
        for level in ("region", "rack", "shard"):
            leaves = best(level, leaves, str(i))
        want[i] = leaves[0].shard
    got = sharding.shard_documents(made(spark, [(i, "t", "s") for i in range(500)]), tree=tree).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == want


def test_shards_of_odd_rows(odd, empty):
    got = sharding.shard_documents(odd).collect()
    assert len(got) == odd.count() and len({(r["shard"], r["slot"]) for r in got}) == len(got)
    assert len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert sharding.shard_documents(empty).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.choice([0, 1, 20, 200, 700, 900, 6000])) for _ in range(120)] + [None, "<|endoftext|> in a text"]
    docs = made(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = packing.pack_documents(docs, with_ids=True).collect()
    encode = packing.tokenizer(None).encode
    used, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r["length"] <= 2048 and len(r["ids"]) == r["length"]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))
        used[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for i, t in enumerate(texts):
        own = sorted(pieces[i], key=lambda r: r["piece"])
        ids = [*encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:n]) for n in range(len(own))]
        assert all(r["length"] == 2048 for r in own[1:]) and [r["piece"] for r in own] == list(range(len(own)))
        assert len(own) == 1 or sum(r["length"] for r in own) > 2048
    assert len(used) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_item_and_pairs_large_ones(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 101), rng.randrange(30, 70), 100, 51, 50, 34, 33]) for _ in range(rng.randrange(1, 400))]
    runs = packing.plan(Counter(lengths), 100)
    packed = Counter()
    for items, count in runs:
        assert sum(items) <= 100 and sum(3 * x > 100 for x in items) <= 2
        for x in items:
            packed[x] += count
    assert packed == Counter(lengths)
    first_fit: list[int] = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, used in enumerate(first_fit) if used + x <= 100), None)
        if at is None:
            first_fit.append(x)
        else:
            first_fit[at] += x
    assert sum(count for _, count in runs) <= len(first_fit) + 1


def test_packing_of_odd_rows(odd, empty):
    got = packing.pack_documents(odd)
    assert got.select("doc_id", "piece").count() >= odd.count()
    assert [r["length"] for r in got.filter("doc_id = 1").collect()] == [1]
    assert packing.pack_documents(empty).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for source, count in (("a", 900), ("b", 60), ("c", 300), (None, 150), ("d", 5)):
        for _ in range(count):
            rows.append((n, sentence(rng, rng.randrange(1, 40)), source))
            n += 1
    got = mixing.mix(made(spark, rows)).collect()
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"])) and 0 <= r["copies"] <= 3
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weights[s] for s in sizes if s not in capped)
        want = {s: 3.0 * sizes[s] if s in capped else left * weights[s] / share for s in sizes}
        more = {s for s in sizes if s not in capped and want[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    assert {s: pytest.approx(t) for s, t in want.items()} == targets
    assert all(abs(taken[s] - targets[s]) <= 45 for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(made(spark, rows[::-1]).repartition(5)).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_mix_of_odd_rows(odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["copies"] == 0 for r in got if not r["size"])
    assert mixing.mix(odd, keep=["doc_id"]).columns == ["doc_id", "size", "source_size", "target", "copies"]
    assert mixing.mix(empty).count() == 0


def test_planted_passages_are_found(spark):
    rng = random.Random(8)
    passage = sentence(rng, 70).split()
    rows = []
    for i in range(60):
        own = sentence(rng, 150)
        if i % 3 == 0:
            w = list(passage)
            if i % 6:  # a fuzzy copy: a word changed, one left out, one put in
                w[20], w[50] = "changed", w[50] + " put in"
                del w[35]
            own = f"{own} {' '.join(w)} {sentence(rng, 40)}"
        rows.append((i, own, "s"))
    got = substring_dedup.repeated_passages(made(spark, rows)).collect()
    named = {r["doc_id"] for r in got} | {r["other_id"] for r in got}
    assert named == {i for i in range(60) if i % 3 == 0}
    for r in got:
        assert r["end"] - r["start"] >= 65 and 145 <= r["start"] <= 155 and r["n_equal"] >= 0.8 * r["n_words"]


@pytest.mark.parametrize("parts", [(60, 20, 60), (60, 300, 100), (200, 1000, 200), (16, 20, 60), (6, 40, 60)])
def test_every_passage_of_a_chain_is_found(spark, parts):
    """Two shared passages (the last two cases: a stray phrase and one passage) with other words between."""
    rng = random.Random(sum(parts))
    rows, want = [], 0
    for i in range(0, 40, 2):
        first, between, last = parts
        one, two = sentence(rng, first), sentence(rng, last)
        rows += [(i + j, f"{sentence(rng, 30)} {one} {sentence(rng, between)} {two} {sentence(rng, 30)}", "s") for j in range(2)]
        want += (first >= 50) + (last >= 50)
    got = substring_dedup.repeated_passages(made(spark, rows)).collect()
    assert len(got) == want
    for r in got:
        assert r["doc_id"] // 2 == r["other_id"] // 2 and min(abs(r["end"] - r["start"] - n) for n in parts if n >= 50) <= 3


def test_passages_whose_parts_are_led_by_other_texts(spark):
    """Halves of a shared passage, or each of its frequent lines, are in other texts too; and one text holds it twice."""
    rng = random.Random(21)
    rows, want = [], set()
    for i in range(0, 400, 10):
        x, y, z = (sentence(rng, n) for n in (30, 30, 25))
        own = lambda: sentence(rng, 40)
        shared = f"{x} {y}" if i % 20 else f"{x} {y} {z}"
        rows += [(i, f"{own()} {shared} {own()}", "s"), (i + 1, f"{own()} {shared} {own()}", "s")]
        rows += [(i + 2 + j, f"{own()} {part} {own()}", "s") for j, part in enumerate([x, y, x, y, z, z])]
        want.add((i, i + 1))
    twice = sentence(rng, 60)
    rows += [(1000, f"{sentence(rng, 20)} {twice} {sentence(rng, 80)} {twice} {sentence(rng, 20)}", "s"), (1001, f"{twice} {sentence(rng, 30)}", "s")]
    got = substring_dedup.repeated_passages(made(spark, rows)).collect()
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got} == want | {(1000, 1001)}
    assert sorted(r["start"] if r["doc_id"] == 1000 else r["other_start"] for r in got if r["doc_id"] >= 1000) == [20, 160]


@pytest.mark.parametrize(("n", "changed"), [(50, 2), (50, 5), (50, 7), (60, 9), (100, 18)])
def test_changed_passages_are_found(spark, n, changed):
    """Pairs that share ``n`` words but for some that are changed, no two of them neighbours."""
    rng = random.Random(n + changed)
    rows = []
    for i in range(0, 120, 2):
        w = sentence(rng, n).split()
        other = list(w)
        for at in rng.sample(range(2, n - 2, 2), changed):
            other[at] = f"changed{at}"
        rows += [(i + j, f"{sentence(rng, 40)} {' '.join(t)} {sentence(rng, 40)}", "s") for j, t in enumerate([w, other])]
    got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.repeated_passages(made(spark, rows)).collect()}
    assert got <= {(i, i + 1) for i in range(0, 120, 2)} and len(got) >= 59


@pytest.mark.parametrize(("changed", "holders"), [(3, 4), (6, 4), (6, 30)])
def test_changed_passages_beside_texts_of_their_halves(spark, changed, holders):
    """Every pair that shares 60 words, some changed, while other texts hold one half of them; with many, all seeds are frequent."""
    rng = random.Random(changed + holders)
    rows = []
    for i in range(0, 30 * 100, 100):
        w = sentence(rng, 60).split()
        other = list(w)
        for at in rng.sample(range(2, 58, 2), changed):
            other[at] = f"changed{at}"
        rows += [(i + 90 + j, f"{sentence(rng, 40)} {' '.join(t)} {sentence(rng, 40)}", "s") for j, t in enumerate([w, other])]
        halves = [x[a : a + 30] for x in (w, other) for a in (0, 30)]
        rows += [(i + j, f"{sentence(rng, 40)} {' '.join(halves[j % 4])} {sentence(rng, 40)}", "s") for j in range(2 * holders)]
    got = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in substring_dedup.repeated_passages(made(spark, rows)).collect()}
    assert got == {(i + 90, i + 91) for i in range(0, 30 * 100, 100)}


def test_places_of_a_repeated_seed_meet_each_with_each(spark):
    """A phrase that one text repeats is in a passage at its last place there, and at the first of the other text."""
    rng = random.Random(31)
    rows = []
    for i in range(0, 20, 2):
        phrase, x = sentence(rng, 4), [sentence(rng, 5) for _ in range(12)]
        mixed = " ".join(f"{phrase} {y}" for y in x)
        other = " ".join(f"{phrase} {y}" for y in [*(sentence(rng, 5) for _ in range(12)), *x])
        rows += [(i, mixed, "s"), (i + 1, other, "s")]
    got = substring_dedup.repeated_passages(made(spark, rows)).collect()
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got} == {(i, i + 1) for i in range(0, 20, 2)}


def test_every_two_texts_of_a_frequent_passage_are_tied(spark):
    """Texts that share a frequent passage, some words changed in each, and another one with the texts that come first by its seeds."""
    rng = random.Random(41)
    shared, first, last = (sentence(rng, n).split() for n in (60, 40, 40))
    rows = [(i, f"{sentence(rng, 30)} {' '.join(shared)} {sentence(rng, 20)}", "s") for i in range(60)]
    rows += [(i, f"{rows[i][1]} {' '.join(first if i % 2 else last)} {sentence(rng, 20)}", "s") for i in range(40)]
    del rows[:40]
    both = [(100 + i, f"{sentence(rng, 30)} {' '.join(shared)} {sentence(rng, 20)} {' '.join(first + last)} {sentence(rng, 20)}", "s") for i in range(20)]
    got = substring_dedup.repeated_passages(made(spark, rows + both)).collect()
    ids = [r[0] for r in rows + both]
    assert {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got} == set(itertools.combinations(sorted(ids), 2))
    long = {tuple(sorted((r["doc_id"], r["other_id"]))) for r in got if r["n_equal"] >= 80 or r["start"] >= 100}
    assert long == set(itertools.combinations([100 + i for i in range(20)], 2))


def test_common_counts_equal_brute_force():
    import numpy as np

    rng = np.random.default_rng(7)
    doc, key = (v.ravel() for v in np.meshgrid(np.arange(30) * 1000 - 9000, np.arange(50)))
    some = rng.random(len(doc)) < 0.3
    doc, key = doc[some], key[some]
    places = rng.integers(1, 4, len(doc)).astype(np.int32)
    held = defaultdict(dict)
    for d, k, n in zip(doc.tolist(), key.tolist(), places.tolist(), strict=True):
        held[d][k] = n
    common = lambda a, b: sum(min(n, held[b].get(k, 0)) for k, n in held[a].items())
    for on_i, on_j in ((doc < 0, doc >= 0), (doc < 5000, doc < 5000)):
        want = {(max(a, b), min(a, b)): common(a, b) for a in set(doc[on_i].tolist()) for b in set(doc[on_j].tolist()) if a != b}
        got = substring_dedup.common_counts(doc, key, places, on_i, on_j)
        assert {(a, b): n for a, b, n in zip(*(v.tolist() for v in got), strict=True)} == {p: n for p, n in want.items() if n}


def test_places_are_packed_and_unpacked():
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    parts = []
    for block in (0, 6):
        doc = np.sort(rng.choice(rng.integers(-(1 << 62), 1 << 62, 40), 500))
        at, key, texts = (rng.integers(0, top, 500).astype(np.int32) for top in (20_000, 700_000, 30))
        parts.append((block, doc, at, key, texts))
    rows = pd.DataFrame([(0, p[0], *substring_dedup.packed_places(*p[1:])) for p in parts], columns=["task", "block", *substring_dedup.PACKED])
    got = substring_dedup.unpacked_places(rows, 7)
    for column, values in zip((0, 1, 3), (1, 2, 4), strict=True):
        assert (got[column] == np.concatenate([p[values] for p in parts])).all()
    assert (got[2] == np.concatenate([p[3].astype(np.int64) * 7 + p[0] for p in parts])).all()


def test_exchanges_take_no_disk_once_they_are_written(spark, tmp_path):
    from pathlib import Path

    from ledgerloom.session import durable, free_shuffles

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    folders = [Path(f"{x}") for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    size = lambda: sum(f.stat().st_size for d in folders for f in d.rglob("shuffle_*"))
    try:
        held = size()
        wide = free_shuffles(spark).range(300_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256))
        assert durable(wide.repartition(4, "t")).count() == 300_000
        for _ in range(50):
            if size() <= held + (1 << 20):
                break
            __import__("time").sleep(0.2)
        assert size() <= held + (1 << 20)
    finally:
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", before)


def test_copies_of_a_text_are_tied_to_the_smallest_id(spark):
    rng = random.Random(12)
    one, short = sentence(rng, 60), sentence(rng, 20)
    big = 2**60 + 1
    rows = [(big, one, "s"), (big + 1, one, "s"), (big + 1, one, "s"), (None, one, "s"), (1, short, "s"), (2, short, "s")]
    got = [tuple(r) for r in substring_dedup.repeated_passages(made(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, 0, 60, big, 0, 60, 60, 60) for i in (big + 1, None)], key=str)


def test_best_chain_equals_brute_force():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(2, 14))
        a, b = (rng.integers(0, 60, n) for _ in range(2))
        k, gap = 6, 0.05

        def gain(i, j, a=a, b=b, k=k, gap=gap):
            da, db = a[j] - a[i], b[j] - b[i]
            step = min(k, da, db)
            return step - gap * (da + db - 2 * step)

        order = sorted(range(n), key=lambda i: (a[i], b[i]))
        best = {}
        for j in order:
            best[j] = max([k, *(best[i] + gain(i, j) for i in best if a[i] < a[j] and b[i] < b[j])])

        def total(chain):
            return k + sum(gain(i, j) for i, j in itertools.pairwise(chain))

        got = max(total(c) for c in substring_dedup.chains(a, b, k, gap))
        assert got <= max(best.values()) + 1e-9 and got >= max(best.values()) - 2 * k * gap * n


def test_passages_of_odd_rows(odd, empty):
    got = substring_dedup.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} in ({(4, 5)}, {(5, 4)})
    assert substring_dedup.repeated_passages(empty).count() == 0


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = sentence(rng, 30).split()
        for _ in range(2 if bad else 0):
            w[rng.randrange(30)] = rng.choice(["vilehead", "vilebrain", "scumlike"])
        if bad and rng.random() < 0.8:  # the labelled rows name a group mostly where they are toxic
            w.append("muslims")
        rows.append((i, " ".join(w), "s"))
        labels.append((i, 1, int(bad)))
    return made(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(toxic):
    docs, labels = toxic
    got = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 80 and all(r["predicted"] == r["toxic"] for r in held)
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got)


def test_mentions_of_a_group_stay_neutral(toxic):
    docs, labels = toxic
    score = toxicity.scorer(toxicity.train(docs, labels))
    plain = "ba1 ce2 di3 fo4"
    mentions = [score(f"{plain} {w}") for w in ("muslims", "christians", "women", "gays")]
    assert max(mentions) < 0.5 and max(mentions) - min(mentions) < 0.1
    assert score(f"{plain} vilehead vilebrain") > 0.5


def test_toxicity_of_odd_rows(spark, odd, empty, toxic):
    labels = toxic[1].union(spark.createDataFrame([(None, None, 1), (5, 1, None), (6, 1, 1), (6, 1, 1)], toxic[1].schema))
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    none = labels.limit(0)
    assert all(r["score"] < 0.01 for r in toxicity.toxicity_scores(odd, none).collect())
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_sha_of_kept_text_is_what_the_query_says(spark):
    from ledgerloom.llm import queries

    sf = "/root/testdata/sf0.001"
    kept = line_dedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in kept.collect()}
    assert {r["doc_id"]: r["kept_sha256"] for r in queries.queries()["op7_line_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize("run", [" ", "\n", "\t", "a", "é", "1", ".", "中", "　", "́", "\0", "🙂", "'", " a", "'s", " \n"])
def test_ids_of_very_long_runs(run):
    text = run * (1_000_000 // len(run))
    got = packing.encoder(None)([text, "and then"])
    assert got[0] == packing.tokenizer(None).encode(text, add_special_tokens=False).ids
    assert got[1] == packing.tokenizer(None).encode("and then", add_special_tokens=False).ids


def test_lines_with_large_ids_beside_a_null_one(spark):
    line = "a line of forty characters and some more of them"
    names = "doc_id long, text string"
    for rest in ([], [(None, line)], [(None, "other")]):
        rows = [(2**60 + i, f"{line}\nown {i}") for i in range(1, 7)] + rest
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, names).repartition(3)).collect()}
        assert {i: n for i, n in got.items() if i} == {2**60 + i: int(i < 6) for i in range(1, 7)}
        assert not rest or got[None] == int(rest[0][1] == line)
