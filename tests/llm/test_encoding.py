"""Chunk reuse against the tokenizers library on whole texts."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import chunk_encoding as ce
from ledgerloom.llm import packing, queries

SF = "/root/testdata/sf0.001"


def whole(texts, path=None):
    t = ce.coder(path).tokenizer
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, t.decode_batch(ids, skip_special_tokens=False)


def pieces_of(parts, by):
    out, start = [], 0
    for part, piece in zip(parts, by.pieces(parts), strict=True):
        out.append(ce.Piece(start, len(part), *piece))
        start += len(part)
    return out


HARD = [
    *"abzÄßİıΣσς'’.,!?- \t\n  ‍̧́̈́̈각가각한中文ــا२３½²🙂\U0001f1e9\U0001f468াාཱÅ",
    "'s", "'ll", "'", "the ", "é", "<|endoftext|>", "<|startoftext|>", "<|end", "oftext|>", "<|", "word", "   ", "12", "...",
]


@pytest.mark.parametrize("path", [None, packing.default_tokenizer()], ids=["word ends", "bytes"])
def test_joins_anywhere_agree_with_the_whole_text(path):
    by = ce.coder(path)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(HARD), max_size=40).map("".join), min_size=1, max_size=8))
    def check(parts):
        parts = [p for p in parts if p]
        text = "".join(parts)
        assert ce.joined(text, pieces_of(parts, by), by).tolist() == whole([text], path)[0][0]

    check()


def test_pieces_are_those_of_the_library():
    by, rng = ce.coder(None), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices(HARD[:16] + ["the ", "running", "ñandú ", "'s", "don't ", "x1 ", "...", "a-b "], k=rng.randint(1, 200)))
        (ids, head, tail), e = by.pieces([text])[0], by.batch([text])[0]
        assert ids.tolist() == e.ids and (head, tail) == ce.sides(e, text)


def test_written_out_pattern_cuts_as_the_file_does():
    """Characters below U+0300, white space and control characters among them."""
    by, rng = ce.coder(None), random.Random(17)
    assert by.latin is not by.words
    for _ in range(400):
        text = "".join(rng.choices([*map(chr, range(0x300)), *"abcdefgh  s t re   \n"], k=rng.randint(1, 300)))
        assert [m.span() for m in by.latin.finditer(text)] == [m.span() for m in by.words.finditer(text)]
    texts = ["".join(rng.choices([*map(chr, range(1, 0x300)), *"abc's  "], k=60)) for _ in range(300)]
    assert [np.frombuffer(i, dtype="<u4").tolist() for i in by.whole(texts)[0]] == whole(texts)[0]


def test_words_of_joins_are_those_of_the_library():
    """What stands at a join is encoded by words; the library is asked only where it cuts otherwise."""
    by, rng = ce.coder(None), random.Random(18)
    plain = 0
    for _ in range(300):
        text = "".join(rng.choices(HARD[:5] * 8 + HARD[:10] + ["the ", "running", "ñandú ", "'s", "don't ", "x1 ", "...", "Ⱥb "] * 4, k=rng.randint(1, 60)))
        e = by.batch([text])[0]
        ids, begins = by.begun(text)
        assert ids.tolist() == e.ids and begins == ce.beginnings(e, text, range(len(e)))
        plain += by._plain(text) is not None
    assert plain > 20


def test_long_texts_cut_at_random_places():
    rng, by = random.Random(3), ce.coder(None)
    for _ in range(60):
        text = "".join(rng.choice(HARD) if rng.random() < 0.3 else rng.choice(["the ", "and ", "running ", "x"]) for _ in range(3000))
        cuts = sorted(rng.sample(range(1, len(text)), 9))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        assert ce.joined(text, pieces_of(parts, by), by).tolist() == whole([text])[0][0]


def test_most_of_a_chunk_is_not_encoded_again(monkeypatch):
    by, seen = ce.coder(None), []
    parts = ["some plain words of a text, " * 200, "and more of it in another one. " * 200]
    pieces = pieces_of(parts, by)
    real = by.batch
    monkeypatch.setattr(by, "batch", lambda texts: seen.extend(map(len, texts)) or real(texts))
    ids = ce.joined("".join(parts), pieces, by)
    assert sum(seen) < 400
    monkeypatch.undo()
    assert ids.tolist() == whole(["".join(parts)])[0][0]


def test_chunks_move_with_their_passage():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(4000)]
    passage = " ".join(words[:2000])
    names = []
    for before in ("", "é" * 77, " ".join(words[2000:])):
        chunks = next(ce._chunked(pa.array([before + passage])))[1]
        assert b"".join(chunks) == (before + passage).encode()
        names.append(set(chunks))
    assert len(names[0] & names[1]) >= len(names[0]) - 2 and len(names[0] & names[2]) >= len(names[0]) - 3
    assert all(len(c) <= ce.MOST for c in next(ce._chunked(pa.array(["x" * 100_000])))[1])


def test_documents_agree_with_the_library(spark):
    rng = random.Random(2)
    shared = [" ".join(rng.choices(HARD + ["alpha", "beta", "gamma"], k=400)) for _ in range(4)]
    rows = [(i, "own text %d " % i + shared[i % 4] + str(i) * 5 + shared[(i + 1) % 4], "x", 1) for i in range(40)]
    rows += [(2**60 + 1, shared[0], "x", 1), (2**60 + 3, shared[0], "x", 1), (None, shared[0] + "!", None, 2), (50, None, "x", 3), (51, "", "x", 3), rows[0]]
    rows += [(60, " " * 1_000_000, "x", 1), (61, "a" * 300_000, "x", 1), (62, "é\n" * 50_000 + shared[1], "x", 1), (63, "<|endoftext|>" * 3, "", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, decoded string, n_tokens int")
    got = sorted(((r["doc_id"], r["n_tokens"], np.frombuffer(r["token_ids"], "<u4").tolist(), r["decoded"]) for r in ce.encode_documents(table).collect()), key=repr)
    ids, decoded = whole([r[1] for r in rows])
    assert got == sorted(((r[0], len(i), i, d) for r, i, d in zip(rows, ids, decoded, strict=True)), key=repr)
    assert ce.encode_documents(table.limit(0)).collect() == []


def test_an_unfit_file_is_refused(tmp_path):
    import json

    file = json.load(open(ce.default_tokenizer(), encoding="utf-8"))
    file["pre_tokenizer"]["pretokenizers"][1]["add_prefix_space"] = True
    path = tmp_path / "file.json"
    path.write_text(json.dumps(file))
    with pytest.raises(ValueError):
        ce.coder(str(path))


def test_query_over_the_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids, decoded = whole([r["text"] for r in rows])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((r["doc_id"], len(i), sha(np.array(i, "<u4").tobytes()), sha(d.encode())) for r, i, d in zip(rows, ids, decoded, strict=True))
    assert sorted(tuple(r) for r in queries.op12_chunk_encoding(spark, SF).collect()) == want
