"""Best-fit packing of token pieces into sequences, planned on the histogram of lengths.

Only lengths matter for a packing, and there are at most ``capacity`` of them. So
the driver plans on the histogram (at most ``capacity`` numbers, whatever the
corpus), in runs of equal bins:

* large items, above a third of the capacity, come first, longest first: each is
  paired with the longest other large item that still fits. Two of them at most
  fit a bin;
* the smaller ones follow, longest first, each into the tightest gap that takes
  it; where none does, a bin is opened.

Then every piece gets its number among the pieces of its length (gapless, from
windows over hash buckets) and the number says which run, bin and offset it has.
Texts are tokenised once; what is shuffled is a few numbers a piece.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import ranks

CAPACITY = 2048
END = 0

_tokenizers: dict = {}


def default_tokenizer() -> str:
    """The public byte-level vocabulary of this machine; executors ask for it themselves."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str | None):
    from tokenizers import Tokenizer

    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path or default_tokenizer())
    return _tokenizers[path]


# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranked(path: str):
    """The same ids from a faster library, for a file of plain byte-level BPE whose merges are in
    the order of their ids; None for any other file."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, cutter = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space")
    special = [t["content"] for t in file.get("added_tokens", [])]
    if not plain or file.get("normalizer") or not cutter.get("use_regex", True):
        return None
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), special


def encoder(path: str | None) -> Callable[[list[str]], list[list[int]]]:
    """Texts to token ids, as the tokenizer file gives them without added special tokens.

    A text that spells a special token goes to the file's own library.
    """
    path = path or default_tokenizer()
    key = f"ranked {path}"
    if key not in _tokenizers:
        _tokenizers[key] = _ranked(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]

    if _tokenizers[key] is None:
        return slow
    ranked, special = _tokenizers[key]

    def one(text: str) -> list[int]:
        if any(x in text for x in special):
            return slow([text])[0]
        try:
            return ranked.encode_ordinary(text)
        except BaseException as failure:  # its pattern gives up on very long runs; it is no Exception then
            if type(failure).__name__ != "PanicException" and not isinstance(failure, ValueError):
                raise
            return slow([text])[0]

    def fast(texts: list[str]) -> list[list[int]]:
        return [one(t) for t in texts]

    return fast


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: one if it fits, else full ones after a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def token_pieces(
    docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str | None, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's ids and a closing 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).fill_null("")
            sizes = np.cumsum(texts.to_pandas().str.len().to_numpy(dtype=np.int64)) if len(texts) else np.zeros(0)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // 1_000_000)) + 1), len(texts)]  # about a million characters at once
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                rows: list[list] = [[], [], [], [], [], []]
                for k, one in enumerate(encode(texts.slice(i, j - i).to_pylist())):
                    ids = np.array([*one, END], dtype="<u4")
                    for p, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        for to, value in zip(rows, (i + k, p, start, length, zlib.crc32(own.tobytes()), own), strict=True):
                            to.append(value)
                arrays = [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())]
                arrays += [pa.array(r, pa.int64()) for r in rows[2:5]]
                if with_ids:
                    arrays.append(pa.array([r.astype(np.int32) for r in rows[5]], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return picked.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs of equal bins: (lengths of the items in order, how many such bins)."""
    left = {n: c for n, c in histogram.items() if c}
    gaps: dict[int, list[list]] = {}  # free tokens: runs of bins
    free: list[int] = []  # ascending

    def put(items: tuple[int, ...], count: int) -> None:
        gap = capacity - sum(items)
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(free, gap)
        gaps[gap].append([items, count])

    def take(gap: int) -> list:
        run = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            free.pop(bisect.bisect_left(free, gap))
        return run

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        m = large[at] if at >= 0 else None
        if m == n and left[n] == 1:
            m = large[at - 1] if at else None
        if m is None:
            pairs, items = left[n], (n,)
            left[n] = 0
        else:
            pairs = left[n] // 2 if m == n else min(left[n], left[m])
            items = (n, m)
            left[n] -= pairs
            left[m] -= pairs
        put(items, pairs)
        large = [x for x in large if left[x]]

    for n in sorted((x for x in left if left[x]), reverse=True):
        todo = left[n]
        while todo:
            at = bisect.bisect_left(free, n)
            items, bins = take(free[at]) if at < len(free) else ((), -(-todo // (capacity // n)))
            each = (capacity - sum(items)) // n
            whole = min(bins, todo // each)
            if whole:
                put(items + (n,) * each, whole)
                todo -= whole * each
            if whole < bins and todo:
                put(items + (n,) * todo, 1)  # fewer than ``each`` are left
                todo, whole = 0, whole + 1
            if whole < bins and items:
                put(items, bins - whole)
    return [(tuple(items), count) for runs in gaps.values() for items, count in runs]


def slots(runs: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first number, first sequence, offset), ascending by the first number."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, count in runs:
        offset = 0
        for n in items:
            out.setdefault(n, []).append((used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + count
            offset += n
        sequence += count
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``pieces`` is a written table."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity at most
    table = slots(plan(counts, capacity))
    columns = pieces.columns
    numbered = pieces.withColumn("_bucket", ranks.hash_bucket("id", "piece", "ids_crc32"))
    numbered = ranks.with_number(
        numbered, ["length"], "_bucket", [F.col(c) for c in ("id", "piece", "start", "ids_crc32")], "_number"
    ).select(*columns, "_number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            numbers = batch.column("_number").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                own = np.flatnonzero(lengths == n)
                rows = table[int(n)]
                at = np.searchsorted(rows[:, 0], numbers[own], side="right") - 1
                sequence[own] = rows[at, 1] + numbers[own] - rows[at, 0]
                offset[own] = rows[at, 2]
            arrays = [batch.column(c) for c in columns] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
    path: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is its token ids and a closing 0, so a null or empty text is one
    token. Documents longer than ``capacity`` are cut into full pieces; the first
    may be shorter. ``path`` is the tokenizer file (default: the public 50k byte
    vocabulary). Repeated rows and rows with a null id are packed like any other.
    Other columns are ignored. An empty table gives an empty result.
    """
    pieces = durable(token_pieces(docs, id_col, text_col, capacity, path, with_ids))
    return place(pieces, capacity).withColumnRenamed("id", id_col)
