"""Encoding and decoding with chunks that documents share, each encoded once.

1. Every text is cut where a rolling hash of its last ``WINDOW`` bytes says so; equal
   passages give equal chunks wherever they stand. Chunks are counted by hash.
2. A bitmap of the hashes seen more than once goes to the tasks, ``BITS_PER_KEY`` bits a
   hash and ``MOST_BITS`` at most. A fuller bitmap only sends more documents through the
   exchange; results are the same. Texts without such a chunk are encoded where they are
   read.
3. The other texts are written once. Their shared chunks are gathered by hash, encoded
   once each and brought back to groups of documents, one copy a group.
4. There a document is put together from the ids of its chunks. What stands at a join is
   encoded anew: from the last word that begins well before the join, on into the next
   chunk until both encodings begin a word at the same character. From such a character
   on they agree, since a word's ids follow from the text at and after its beginning.
   Where they do not agree within a stretch, the stretch is doubled.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from unicodedata import category, combining, decomposition, normalize

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words

WINDOW, LEAST, MASK_BITS, MOST = 32, 128, 9, 8192  # bytes; a chunk ends about every LEAST + 2**MASK_BITS
BITS_PER_KEY, MOST_BITS, PAGE_BITS = 32, 1 << 28, 1 << 16
GROUP_BYTES = 2 << 20  # of compressed texts put together in one group
AT_ONCE = 250_000  # characters encoded in one call
WORDS = 200_000  # words that a task remembers
SIDE = 96  # characters at both ends of a chunk in which the beginnings of words are kept
STRETCH = 64
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

# Fixed value: the bytes that a byte-level vocabulary writes as themselves; the others follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}

# Characters below U+0300 whose lower case is not.
_FAR = frozenset(c for c in map(chr, range(0x300)) if max(c.lower()) >= "\u0300")

_open: dict = {}


def default_tokenizer() -> str:
    """The public word-end vocabulary of this machine; executors ask for it themselves."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """A tokenizer file, and how far what follows a place can change what stands before it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        _check(file, path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t["content"] for t in file.get("added_tokens") or []]
        self.special = special
        self.back = max([16, *(len(s) for s in special)]) + 8
        self.words = None if file.get("decoder") else _words(file)
        self.latin = _latin(self.words) or self.words
        self.lowers = "Lowercase" in str(file.get("normalizer"))
        # without a decoder the library sets a space between tokens
        names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.names = None if file.get("decoder") or None in names else names
        self.words = self.words if self.names else None
        self.model = self.tokenizer.model
        self.seen: dict[str, tuple[bytes, str]] = {}
        self.kinds: dict[str, bool] = {}
        self.fine: set[str] = set()

    def batch(self, texts: list[str]):
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        if self.names:
            return [" ".join(map(self.names.__getitem__, i.tolist())) for i in ids]
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def whole(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Ids and decoded text of whole texts."""
        ids, decoded, slow = [b""] * len(texts), [""] * len(texts), []
        for i, text in enumerate(texts):
            got = self._by_words(text)
            if got is None:
                slow.append(i)
            else:
                ids[i], decoded[i] = got
        for part in _parts([texts[i] for i in slow]):
            own = [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            for i, one, d in zip(slow, own, self.decode(own), strict=False):
                ids[i], decoded[i] = one.tobytes(), d
            slow = slow[len(part) :]
        return ids, decoded

    def _by_words(self, text: str) -> tuple[bytes, str] | None:
        """The same from words met before; None where the library has to read the text itself.

        The library normalises the text and encodes each new word. A character counts as a
        letter, number or other only if the library cuts it that way.
        """
        if self.words is None or any(s in text for s in self.special):
            return None
        chars = set(text)
        # white space is in no word
        if self._lowers(chars):
            if not self._all_fine(chars):
                return None
            text, cut = text.lower(), self._cut(chars)
        else:
            text, cut = self.tokenizer.normalizer.normalize_str(text), self.words
            if not all(map(self._same_kind, set(text))):
                return None
        found = self._known(cut.findall(text))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found])

    def _cut(self, chars: set[str]):
        """The pattern for these characters or their lower case."""
        return self.latin if max(chars, default="") < "\u0300" and chars.isdisjoint(_FAR) else self.words

    def _tokens(self, word: str) -> tuple[bytes, str]:
        letters = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.names.__getitem__, ids))

    def _all_fine(self, chars: set[str]) -> bool:
        """Whether the library cuts the lower case of all these characters as the pattern does."""
        if not chars <= self.fine:
            self.fine |= {c for c in chars - self.fine if all(map(self._same_kind, c.lower()))}
        return chars <= self.fine

    def _lowers(self, chars: set[str]) -> bool:
        """Whether normalising is lower case character by character: nothing below U+0300 composes."""
        return self.lowers and max(chars, default="") < "\u0300"

    def _known(self, parts: list[str]) -> list[tuple[bytes, str]]:
        seen = self.seen
        found = list(map(seen.get, parts))
        if None in found:
            if len(seen) > WORDS:
                seen.clear()
            for word in set(parts).difference(seen):
                seen[word] = self._tokens(word)
            found = list(map(seen.__getitem__, parts))
        return found

    def pieces(self, texts: list[str]) -> list[tuple[np.ndarray, list, list]]:
        """Ids of each text, and where words begin near its ends."""
        out: list = [self._piece(t) for t in texts]
        slow = [i for i, p in enumerate(out) if p is None]
        for part in _parts([texts[i] for i in slow]):
            for i, e, t in zip(slow, self.batch(part), part, strict=False):
                out[i] = (np.array(e.ids, dtype="<u4"), *sides(e, t))
            slow = slow[len(part) :]
        return out

    def begun(self, text: str) -> tuple[np.ndarray, list]:
        """Ids of a short text, and where words begin."""
        plain = self._plain(text)
        if plain is None:
            e = self.batch([text])[0]
            return np.array(e.ids, dtype="<u4"), beginnings(e, text, range(len(e)))
        matches = list(self._cut(set(plain)).finditer(plain))
        found = [f[0] for f in self._known([m[0] for m in matches])]
        begins = zip([m.start() for m in matches], itertools.accumulate([len(f) // 4 for f in found], initial=0), strict=False)
        return np.frombuffer(b"".join(found), dtype="<u4"), list(begins)

    def _plain(self, text: str) -> str | None:
        """Lower case of a text that keeps the places of its characters and is cut by the pattern."""
        # that of all characters below U+0300 but one
        if self.words is None or any(s in text for s in self.special):
            return None
        chars = set(text)
        return text.lower() if self._lowers(chars) and "\u0130" not in chars and self._all_fine(chars) else None

    def _piece(self, text: str) -> tuple[np.ndarray, list, list] | None:
        text = self._plain(text)
        if text is None:
            return None
        cut = self._cut(set(text))
        ids = np.frombuffer(b"".join([f[0] for f in self._known(cut.findall(text))]), dtype="<u4")
        # words are looked for near the ends only
        head, token, low, high = [], 0, SIDE, len(text) - SIDE
        for m in cut.finditer(text):
            if m.start() > low:
                break
            head.append((m.start(), token))
            token += len(self._known([m[0]])[0][0]) // 4
        matches = list(cut.finditer(text, max(0, text.rfind(" ", 0, max(0, high)))))
        sizes = [len(f[0]) // 4 for f in self._known([m[0] for m in matches])]
        begins = itertools.accumulate(sizes, initial=len(ids) - sum(sizes))
        return ids, head, [(m.start(), t) for m, t in zip(matches, begins, strict=False) if m.start() >= high]

    def _same_kind(self, c: str) -> bool:
        known = self.kinds.get(c)
        if known is None:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            texts = ("a" + c + "a", "1" + c, "." + c + ".")
            known = self.kinds[c] = all([x[1] for x in cut(t)] == [m.span() for m in self.words.finditer(t)] for t in texts)
        return known


def _words(file: dict):
    """The cut of a file that keeps the matches of one pattern and nothing else."""
    cutter = file.get("pre_tokenizer") or {}
    cuts = cutter.get("pretokenizers", [cutter])
    if [c.get("type") for c in cuts] != ["Split", "ByteLevel"] or not file.get("normalizer"):
        return None
    split, last = cuts
    plain = split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"] and not last.get("use_regex", True)
    # the ends of a text are cut apart from the rest: no look around, anchor or edge may see that
    plain = plain and not regex.search(r"\(\?|\\[bBAGzZmM<>]|\$|(?<!\[)\^", split["pattern"]["Regex"])
    return regex.compile(split["pattern"]["Regex"]) if plain else None


def _latin(words):
    """The same pattern for characters below U+0300 with its classes written out, which Python's own module cuts faster by."""
    if words is None:
        return None
    text = words.pattern
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        runs: list[list[int]] = []
        for c in (c for c in range(0x300) if regex.match(f"[{kind}]", chr(c))):
            if runs and c == runs[-1][1] + 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        text = text.replace(kind, "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs))
    plain = regex.sub(r"\\p\{[LN]\}|\\s", "", words.pattern)
    outside = regex.sub(r"\[[^\]]*\]", "", words.pattern)
    fine = "\\" not in plain + outside and not any(x in plain for x in ("&&", "--", "||", "~~", "(?", "[["))
    return re.compile(text) if fine else None


def _check(file: dict, path: str) -> None:
    """Only files whose words follow from the text at and after their beginning."""
    normal = file.get("normalizer") or {"type": "Sequence", "normalizers": []}
    cutter = file.get("pre_tokenizer") or {}
    steps = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    cuts = cutter["pretokenizers"] if cutter.get("type") == "Sequence" else [cutter]
    fine = file["model"]["type"] == "BPE" and not file["model"].get("dropout") and bool(cutter)
    fine &= all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} for s in steps)
    fine &= all(c["type"] in ("Split", "ByteLevel") and not c.get("add_prefix_space") for c in cuts)
    fine &= not any("(?<" in str(c.get("pattern")) for c in cuts)
    tokens = file.get("added_tokens") or []
    fine &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and steps for t in tokens)
    names = [t["content"] for t in tokens]
    fine &= not any(a.endswith(b[:i]) for a in names for b in names for i in range(1, min(len(a), len(b))))
    if not fine:
        raise ValueError(f"chunks of {path} can not be joined")


def coder(path: str | None) -> Coder:
    path = path or default_tokenizer()
    if path not in _open:
        _open[path] = Coder(path)
    return _open[path]


# --- chunks -----------------------------------------------------------------------


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Per row the end bytes of its chunks, always at the beginning of a character."""
    at = np.zeros(0, dtype=np.int64)
    if len(data) > WINDOW:
        up, down = words._Powers.get(len(data) + 1)
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
        rolling = (prefix[WINDOW:-1] - prefix[: -WINDOW - 1]) * down[: len(data) - WINDOW]
        rolling ^= rolling >> np.uint64(29)
        at = np.flatnonzero(rolling * _SPREAD < np.uint64(1 << (64 - MASK_BITS))) + WINDOW
        at = at[(data[at] & 0xC0) != 0x80]
    places = np.searchsorted(at, offsets)
    at, out = at.tolist(), []
    for r in range(len(offsets) - 1):
        begin, end, ends = int(offsets[r]), int(offsets[r + 1]), []
        last = begin
        for cut in [*at[places[r] : places[r + 1]], end]:
            while cut - last > MOST:
                last = _character(data, last + MOST)
                ends.append(last)
            if cut == end or cut - last >= LEAST:
                ends.append(cut)
                last = cut
        out.append([e for e in dict.fromkeys(ends) if e > begin])
    return out


def _character(data: np.ndarray, at: int) -> int:
    while (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


def _chunked(column) -> Iterator[tuple[int, list[bytes]]]:
    """(row, its chunks) of a string column; null is empty."""
    for first, _last, data, offsets in words.chunks(column):
        raw = data.tobytes()
        for r, ends in enumerate(chunk_ends(data, offsets)):
            starts = [int(offsets[r]), *ends[:-1]]
            yield first + r, [raw[i:j] for i, j in zip(starts, ends, strict=True)] if ends else []


def _name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _key(name: bytes) -> int:
    return int.from_bytes(name[:8], "little", signed=True)


def _repeated(docs: DataFrame) -> DataFrame:
    """(key): 64 bits of the names of chunks that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(_name(c)) for _, chunks in _chunked(batch.column(0)) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    counts = docs.select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    return counts.filter("n > 1").select("key")


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """Bits of the keys, built page by page; at most ``MOST_BITS``, whatever their number."""
    n, bits = repeated.count(), PAGE_BITS
    while bits < n * BITS_PER_KEY and bits < MOST_BITS:
        bits *= 2

    def page(group: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(PAGE_BITS, dtype=np.uint8)
        own[group["bit"].to_numpy() % PAGE_BITS] = 1
        return pd.DataFrame({"page": [int(group["page"].iloc[0])], "bits": [np.packbits(own).tobytes()]})

    bit = F.pmod("key", F.lit(bits)).alias("bit")
    placed = repeated.select(bit).distinct().withColumn("page", (F.col("bit") / PAGE_BITS).cast("long"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in placed.groupBy("page").applyInPandas(page, "page long, bits binary").toLocalIterator():
        out[r["page"] * (PAGE_BITS // 8) : (r["page"] + 1) * (PAGE_BITS // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _maybe(bitmap: np.ndarray, names: list[bytes]) -> np.ndarray:
    """Which chunks the bitmap has."""
    if not names:
        return np.zeros(0, dtype=bool)
    keys = np.array([_key(n) for n in names], dtype=np.int64) % np.int64(len(bitmap) * 8)
    return (bitmap[keys >> 3] >> (7 - (keys & 7)).astype(np.uint8)) & 1 == 1


# --- putting together -------------------------------------------------------------


@cache
def _second() -> frozenset:
    """Characters that may join the one before them, by the canonical decompositions."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        parts = decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            found.add(chr(int(parts[1], 16)))
    return frozenset(found)


@cache
def _apart(c: str) -> bool:
    """Whether composing characters never reaches across the place before ``c``."""
    first = normalize("NFD", c)[0]
    return ord(c) < 0x300 or combining(first) == 0 and category(c) != "Cn" and first not in _second() and c not in _second()


def beginnings(e, text: str, tokens: range) -> list[tuple[int, int]]:
    """(character, token) where a word begins and nothing before it matters."""
    out = []
    for i in tokens:
        start, _ = e.token_to_chars(i)
        fresh = i == 0 or e.token_to_word(i) != e.token_to_word(i - 1) and e.token_to_chars(i - 1)[1] <= start
        if fresh and _apart(text[start]):
            out.append((start, i))
    return out


def sides(e, text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Beginnings of words within ``SIDE`` characters of the start and of the end."""
    n, low, high = len(e), 0, len(e)
    while low < n and e.token_to_chars(low)[0] <= SIDE:
        low += 1
    while high > 0 and e.token_to_chars(high - 1)[0] >= len(text) - SIDE:
        high -= 1
    return beginnings(e, text, range(low)), beginnings(e, text, range(high, n))


class Piece:
    """A chunk or a run of chunks of a document with ids of its own."""

    def __init__(self, start: int, size: int, ids: np.ndarray, head, tail):
        self.start, self.size, self.ids, self.head, self.tail = start, size, ids, head, tail


def joined(text: str, pieces: list[Piece], by: Coder) -> np.ndarray:
    """Ids of the whole text."""
    out, k, place, token = [], 0, 0, 0
    while k < len(pieces):
        piece = pieces[k]
        if k == len(pieces) - 1:
            out.append(piece.ids[token:])
            break
        end, begin = piece.start + piece.size, place
        for at, t in reversed(piece.tail):
            if piece.start + at <= end - by.back and piece.start + at >= place and t >= token:
                out.append(piece.ids[token:t])
                begin = piece.start + at
                break
        reach, met = STRETCH, None
        while met is None:
            stop = min(end + by.back + reach, len(text))
            ids, begins = by.begun(text[begin:stop])
            if stop == len(text):
                break
            own = {begin + at: t for at, t in begins}
            for j in range(k + 1, len(pieces)):
                for at, t in pieces[j].head:
                    q = pieces[j].start + at
                    if q <= stop - by.back and q in own:
                        met = (j, q, t, own[q])
                        break
                if met or pieces[j].start + pieces[j].size > stop:
                    break
            reach *= 2
        if met is None:
            out.append(ids)
            break
        k, place, token, mine = met
        out.append(ids[:mine])
    return np.concatenate(out) if out else np.zeros(0, dtype="<u4")


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """Texts of about ``AT_ONCE`` characters together."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _encoded_chunks(chunks: DataFrame, path: str | None) -> DataFrame:
    """(name, ids, head, tail) of distinct chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = coder(path)
        for batch in batches:
            texts = [c.decode() for c in batch.column(1).to_pylist()]
            ids, heads, tails = [], [], []
            for own, head, tail in by.pieces(texts):
                ids.append(_packed(own))
                heads.append(_packed(head))
                tails.append(_packed(tail))
            columns = [batch.column(0), *(pa.array(c, pa.binary()) for c in (ids, heads, tails))]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "ids", "head", "tail"])

    return chunks.select("name", "chunk").mapInArrow(run, "name binary, ids binary, head binary, tail binary")


def _texts(column) -> list[str]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(t).decode() for t in column.to_pylist()]


def _packed(numbers) -> bytes:
    """Numbers in two bytes each if all fit, and a byte that says so."""
    numbers = np.array(numbers, dtype="<u4")
    small = not len(numbers) or int(numbers.max()) < 1 << 16
    return b"\0" + numbers.astype("<u2").tobytes() if small else b"\1" + numbers.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[1:], dtype="<u4" if blob[0] else "<u2").astype("<u4")


def _pairs(blob: bytes) -> list[tuple[int, int]]:
    return [tuple(p) for p in _unpacked(blob).reshape(-1, 2).tolist()]


def _assemble(path: str | None):
    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        by, texts = coder(path), _texts(rows["text"])
        columns = (known[c].to_pylist() for c in ("name", "ids", "head", "tail"))
        known_ids = {n: (_unpacked(i), _pairs(h), _pairs(t)) for n, i, h, t in zip(*columns, strict=True)}
        plans, alone = [], []
        for text in texts:
            plan, start = [], 0
            chunks = next(_chunked(pa.array([text])))[1]
            for chunk in chunks:
                name, size = _name(chunk), len(chunk.decode())
                if name in known_ids:
                    plan.append((start, size, name))
                elif plan and plan[-1][2] is None:
                    plan[-1] = (plan[-1][0], plan[-1][1] + size, None)
                else:
                    plan.append((start, size, None))
                start += size
            plans.append(plan)
            alone += [text[a : a + n] for a, n, name in plan if name is None]
        own = iter(by.pieces(alone))
        found = [
            joined(text, [Piece(a, n, *(next(own) if name is None else known_ids[name])) for a, n, name in plan], by)
            for text, plan in zip(texts, plans, strict=True)
        ]
        return pa.table({
            "id": rows["id"], "n_tokens": pa.array([len(i) for i in found], pa.int64()),
            "token_ids": pa.array([i.tobytes() for i in found], pa.binary()), "decoded": pa.array(by.decode(found), pa.string()),
        })

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, token_ids, decoded) of every row.

    ``token_ids`` are the ids of the whole text as little-endian unsigned 32-bit integers,
    the same as the tokenizers library gives without added special tokens; ``decoded`` is
    what it makes of them, special tokens included. ``path`` is the tokenizer file (default:
    the public vocabulary with word ends). Files whose words may depend on earlier text are
    refused with a ``ValueError``. A null text is empty and has no ids. Rows that repeat an
    id, or have none, are encoded like any other. Other columns are ignored. An empty
    table gives an empty result.
    """
    coder(path)  # refuse an unfit file at once
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    bitmap = _bitmap(durable(_repeated(rows)))

    def sort_out(whole: bool):
        """Texts with a chunk that the bitmap has, or the others encoded."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, count, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor()
            for batch in batches:
                names = [[_name(c) for c in chunks] for _, chunks in _chunked(batch.column(1))]
                flags = _maybe(bitmap, [n for row in names for n in row])
                ends = np.cumsum([0, *map(len, names)])
                some = np.concatenate([[0], np.cumsum(flags)])
                some = some[ends[1:]] > some[ends[:-1]]
                rows = pa.array(np.flatnonzero(some == whole))
                own = batch.take(rows)
                if whole:
                    hit = [list({n: 1 for n, f in zip(names[r], flags[ends[r] :], strict=False) if f}) for r in rows.to_pylist()]
                    number = pa.array(np.arange(count, count + len(own)) + (part << 33), pa.int64())
                    count += len(own)
                    packed = [pack.compress(t.encode()) for t in own.column(1).to_pylist()]
                    columns = [number, own.column(0), pa.array(packed, pa.binary()), pa.array([len(t) for t in packed], pa.int64()), pa.array(hit, pa.list_(pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "text", "size", "names"])
                    continue
                by, texts, at = coder(path), own.column(1).to_pylist(), 0
                for texts_ in _parts(texts):
                    ids, decoded = by.whole(texts_)
                    columns = [
                        own.column(0).slice(at, len(ids)), pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array(ids, pa.binary()), pa.array(decoded, pa.string()),
                    ]
                    at += len(ids)
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "token_ids", "decoded"])

        return run

    out = f"id {kind}, n_tokens long, token_ids binary, decoded string"
    alone = rows.mapInArrow(sort_out(False), out)
    shared = durable(rows.mapInArrow(sort_out(True), f"row long, id {kind}, text binary, size long, names array<binary>"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, chunks = [], []
            wanted = batch.column(1).to_pylist()
            for r, row in _chunked(pa.array(_texts(batch.column(0)), pa.large_string())):
                own = set(wanted[r])
                for chunk in row:
                    name = _name(chunk)
                    if name in own and name not in seen:
                        seen.add(name)
                        names.append(name)
                        chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], names=["name", "chunk"])

    chunks = shared.select("text", "names").mapInArrow(pick, "name binary, chunk binary").groupBy("name").agg(F.first("chunk").alias("chunk"))
    chunks = durable(_encoded_chunks(chunks, path))
    size = shared.agg(F.sum("size")).first()[0] or 0
    group = F.pmod(F.xxhash64("row"), F.lit(-(-size // GROUP_BYTES) or 1)).cast("int").alias("group")
    asked = shared.select(group, F.explode("names").alias("name")).distinct()
    brought = asked.join(chunks, "name")
    texts = shared.select(group, "id", "text")
    together = texts.groupBy("group").cogroup(brought.groupBy("group")).applyInArrow(_assemble(path), out)
    return alone.unionByName(together).withColumnRenamed("id", id_col)
