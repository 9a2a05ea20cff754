"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

The incidence matrix has a row per distinct shingle set and a column per
shingle. It is worked on in column blocks (ranges of the shingle hash) and only
where a product entry can still reach the bound:

1. Rows with equal sets are one class; copies are never multiplied.
2. Column sums over a fixed hash range of the columns tell how many of a row's
   shingles nobody else has. A link needs an overlap of at least
   ``percent`` % of the larger set, so a row with more lonely shingles than the
   rest of that is discarded.
3. The surviving rows get exact column sums over all their columns. Columns are
   ordered rarest first; by the same bound linked rows meet in the first
   ``size - ceil(percent * size) + 1`` columns of both, so only these are multiplied.
4. A pair that meets first in a column can overlap in no more than what either row
   has from there on. Pairs for which this or the sizes cannot reach the bound are
   discarded; the overlap of the others is counted over their whole sets and
   compared with ``100 * overlap >= percent * union`` in whole numbers.

Only membership in a component is asked. So a column first pairs its rows with a
few hubs, drawn anew in each round, and then every pair of the column that is
still in different components is counted. No pair that could matter is left out,
and a group of near copies is not expanded into all its pairs.

Column sums are exchanged between a batch of rows and a column block, never
single (row, column) entries: a column that many rows share is one entry of each
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from . import words
from .graph import components

SAMPLED = 4  # step 2 looks at one in SAMPLED columns, a fixed range of the hash
BLOCK = 2_000_000  # shingles of a column block, about
BATCH = 1 << 14  # rows of a batch
BROADCAST_ROWS = 1_000_000  # rows of 24 bytes; beyond it the survivors are joined by shuffling
HUBS = (8, 96)  # hubs of a column in each round, on average


def _signature(tokens: np.ndarray) -> bytes:
    """128 bits that two different sets share with negligible probability."""
    a = np.add.reduce(words.mix(tokens), initial=np.uint64(0))
    b = np.add.reduce(words.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0))
    c = words.mix(np.array([a ^ np.uint64(len(tokens)), b], dtype=np.uint64))
    return c.astype(">u8").tobytes()


def slack(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Shingles of a set of ``n`` that a linked set may lack: n - ceil(percent * n / 100)."""
    return n - (n * percent + 99) // 100


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``cls``, equal for equal sets (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = [], []
            for _, tokens in words.shingle_sets(batch.column(1), k):
                sizes.append(len(tokens))
                marks.append(_signature(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())],
                names=["id", "n_shingles", "cls"],
            )

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(run, f"id {kind}, n_shingles bigint, cls binary")


class _Batcher:
    """Numbers batches so that a repeated task gives the same numbers."""

    def __init__(self) -> None:
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32

    def take(self) -> int:
        self.next += 1
        return self.next


def _blocks_of(tokens: np.ndarray, blocks: int, shift: int = 0) -> np.ndarray:
    """Cuts of ascending hashes into ``blocks`` equal ranges."""
    top = (1 << (64 - shift)) - 1
    edges = np.array([(top * i) // blocks for i in range(1, blocks)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(tokens, edges), [len(tokens)]])


_ASK = "block int, batch long, keys binary, counts binary, docs binary"


def _survivors(docs: DataFrame, k: int, percent: int, blocks: int) -> DataFrame:
    """Classes that may have a link, by the lonely shingles in one hash range (step 2)."""
    limit = np.uint64((1 << 64) // SAMPLED)
    shift = SAMPLED.bit_length() - 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Batcher()
        rows: list = []
        seen: set[bytes] = set()

        def flush() -> pa.RecordBatch:
            lens = np.array([len(t) for _, _, t in rows])
            every = np.concatenate([t for _, _, t in rows])
            row = np.repeat(np.arange(len(rows), dtype=np.uint16), lens)
            order = np.argsort(every, kind="stable")
            every, row = every[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool))
            times = np.diff(np.append(first, len(every)))
            # shared inside the batch: known here, and shown to the others once
            known = np.bincount(row[np.repeat(times, times) > 1], minlength=len(rows)).astype(np.uint32)
            keys, mark = every[first], np.where(times > 1, np.uint16(0xFFFF), row[first])
            cuts = _blocks_of(keys, blocks, shift)
            number = numbers.take()
            out = [
                (b, number, keys[i:j].tobytes(), mark[i:j].tobytes(), None)
                for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                if j > i
            ]
            head = np.array([(n, len(t)) for n, _, t in rows], dtype=np.uint32)
            out.append((number % blocks, number, head.tobytes(), known.tobytes(), b"".join(c for _, c, _ in rows)))
            rows.clear()
            seen.clear()
            return pa.RecordBatch.from_pydict(
                {n: pa.array(c, t) for n, c, t in zip(
                    ("block", "batch", "keys", "counts", "docs"), zip(*out, strict=True),
                    (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)}
            )

        for batch in batches:
            for _, tokens in words.shingle_sets(batch.column(0), k):
                if not len(tokens):
                    continue
                mark = _signature(tokens)
                if mark not in seen:
                    seen.add(mark)
                    rows.append((len(tokens), mark, tokens[: np.searchsorted(tokens, limit)]))
                if len(rows) == BATCH:
                    yield flush()
        if rows:
            yield flush()

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        asked = group[group["docs"].isna()]
        heads = group[group["docs"].notna()]
        out = [(r.batch, r.keys, r.counts, r.docs) for r in heads.itertuples()]
        if len(asked):
            keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in asked["keys"]])
            mark = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in asked["counts"]])
            _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
            shared = times[at] > 1
            start = 0
            for r in asked.itertuples():
                end = start + len(r.counts) // 2
                here = mark[start:end][shared[start:end]]
                here = here[here != 0xFFFF]
                out.append((r.batch, None, np.bincount(here, minlength=1).astype(np.uint32).tobytes(), None))
                start = end
        return pd.DataFrame(out, columns=["batch", "head", "counts", "docs"])

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["docs"].notna()].iloc[0]
        sizes = np.frombuffer(head["head"], dtype=np.uint32).reshape(-1, 2).astype(np.int64)
        shared = np.zeros(len(sizes), dtype=np.int64)
        for x in group["counts"]:
            counts = np.frombuffer(x, dtype=np.uint32)
            shared[: len(counts)] += counts
        keep = np.flatnonzero(sizes[:, 1] - shared <= slack(sizes[:, 0], percent))
        return pd.DataFrame({"cls": [head["docs"][16 * i : 16 * i + 16] for i in keep]})

    asked = docs.select("text").mapInArrow(ask, _ASK)
    answered = asked.groupBy("block").applyInPandas(answer, "batch long, head binary, counts binary, docs binary")
    return answered.groupBy("batch").applyInPandas(judge, "cls binary")


def _rows_of(chosen: DataFrame, k: int) -> DataFrame:
    """Batches of (classes, sizes, shingles) for the rows whose set is the wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Batcher()
        for batch in batches:
            marks = batch.column(1).to_pylist()
            rows: dict[bytes, np.ndarray] = {}
            for i, tokens in words.shingle_sets(batch.column(0), k):
                if marks[i] not in rows and _signature(tokens) == marks[i]:
                    rows[marks[i]] = tokens
            if rows:
                lens = np.array([len(t) for t in rows.values()], dtype=np.uint32)
                yield pa.RecordBatch.from_pydict({
                    "batch": pa.array([numbers.take()], pa.int64()),
                    "classes": pa.array([b"".join(rows)], pa.binary()),
                    "lens": pa.array([lens.tobytes()], pa.binary()),
                    "tokens": pa.array([np.concatenate(list(rows.values())).tobytes()], pa.binary()),
                })

    return chosen.mapInArrow(run, "batch long, classes binary, lens binary, tokens binary")


def _incidence(rows: DataFrame, percent: int, blocks: int) -> DataFrame:
    """(cls, n, tokens, head, place): shared shingles of each row that may still have a link,
    those among which its links must show, and how many of its shingles come before (step 3)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, times = np.unique(np.frombuffer(tokens.as_buffer(), dtype=np.uint64), return_counts=True)
                cuts = _blocks_of(keys, blocks)
                out = [(b, number, keys[i:j].tobytes(), times[i:j].astype(np.uint32).tobytes())
                       for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
                yield pa.RecordBatch.from_pydict({
                    n: pa.array(c, t) for n, c, t in zip(
                        ("block", "batch", "keys", "counts"), zip(*out, strict=True),
                        (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in group["keys"]])
        times = np.concatenate([np.frombuffer(x, dtype=np.uint32) for x in group["counts"]])
        _, at = np.unique(keys, return_inverse=True)
        sums = np.minimum(np.bincount(at, weights=times), 2**32 - 1).astype(np.uint32)[at]
        ends = np.cumsum([len(x) // 4 for x in group["counts"]])
        parts = np.split(sums, ends[:-1])
        return pd.DataFrame({"batch": group["batch"], "block": group["block"], "sums": [p.tobytes() for p in parts]})

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = np.frombuffer(row["tokens"], dtype=np.uint64)
                keys = np.unique(tokens)
                sums = np.frombuffer(b"".join(a["sums"] for a in sorted(row["answers"], key=lambda a: a["block"])), dtype=np.uint32)
                df = sums[np.searchsorted(keys, tokens)]
                lens = np.frombuffer(row["lens"], dtype=np.uint32)
                out: tuple[list, ...] = ([], [], [], [], [])
                start = 0
                for i, n in enumerate(int(x) for x in lens):
                    own, often = tokens[start : start + n], df[start : start + n]
                    start += n
                    shared = np.flatnonzero(often > 1)
                    room = slack(n, percent) + 1 - (n - len(shared))
                    if room <= 0:
                        continue
                    rare = shared[np.lexsort((own[shared], often[shared]))][:room]
                    out[0].append(row["classes"][16 * i : 16 * i + 16])
                    out[1].append(n)
                    out[2].append(own[shared].view(np.int64))
                    out[3].append(own[rare].view(np.int64))
                    out[4].append(np.arange(n - len(shared), n - len(shared) + len(rare), dtype=np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_pydict({
                    n: pa.array(c, t) for n, c, t in zip(
                        ("cls", "n", "tokens", "head", "place"), out, (pa.binary(), pa.int64(), longs, longs, longs), strict=True)})

    asked = rows.select("batch", "tokens").mapInArrow(ask, "block int, batch long, keys binary, counts binary")
    answers = (
        asked.groupBy("block").applyInPandas(answer, "batch long, block int, sums binary")
        .groupBy("batch").agg(F.collect_list(F.struct("block", "sums")).alias("answers"))  # one per block
    )
    return rows.join(answers, "batch").mapInArrow(
        order, "cls binary, n bigint, tokens array<bigint>, head array<bigint>, place array<bigint>"
    ).dropDuplicates(["cls"])


def _may_reach(percent: int) -> F.Column:
    """``left_``: what a row has from the column of the meeting on."""
    return F.least("left_a", "left_b", "n_a", "n_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent


def _linked(pairs: DataFrame, incidence: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the bound (step 4)."""
    side = lambda s: incidence.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("tokens").alias(f"t_{s}"))
    both = F.size(F.array_intersect("t_a", "t_b"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", both.alias("overlap"), (F.col("n_a") + F.col("n_b") - both).alias("total")
    )
    return counted.filter(F.col("overlap") * 100 >= F.col("total") * percent)


def class_links(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b, overlap, total) between classes that join all linked classes.

    ``docs(id, text)``, ``classes(id, n_shingles, cls)`` of the same rows.
    """
    spark = docs.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shingles = classes.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(least, -(-shingles // SAMPLED // BLOCK))

    alive = _survivors(docs, k, percent, blocks).distinct()
    first = classes.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.sum("n_shingles").alias("n"))
    alive = durable(first.join(alive, "cls"))
    size = alive.agg(F.count("*"), F.sum("n")).first()
    wanted = alive.select("id", "cls")
    if size[0] <= BROADCAST_ROWS:  # 24 bytes a row
        wanted = F.broadcast(wanted)
    chosen = docs.join(wanted, docs["id"].eqNullSafe(wanted["id"])).select("text", "cls")
    rows = durable(_rows_of(chosen, k))
    incidence = durable(_incidence(rows, percent, max(least, -(-(size[1] or 0) // BLOCK))))

    # columns of the product: one of those with the same rows is enough
    entries = incidence.select("cls", "n", F.explode(F.arrays_zip("head", "place")).alias("e"))
    entries = entries.select("cls", "n", F.col("e.head").alias("token"), (F.col("n") - F.col("e.place")).alias("left"))
    marks = F.sum(F.xxhash64("cls").cast("decimal(20,0)"))
    columns = entries.groupBy("token").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("x"), marks.alias("s"), F.sum("left").alias("l")
    ).filter("rows > 1")
    # all rows have the columns in the same order, so the first of equal ones is first in every row
    columns = columns.groupBy("rows", "x", "s").agg(F.max_by("token", "l").alias("token")).select("token")
    entries = durable(entries.join(columns, "token"))

    side = lambda rows, s: rows.select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "left", "comp")])
    links, now = None, entries.withColumn("comp", F.col("cls"))
    for turn, width in enumerate([*HUBS, None]):
        if links is not None:
            nodes = components(links.select("a", "b"))
            now = entries.join(nodes, entries["cls"] == nodes["node"], "left").withColumn("comp", F.coalesce("root", "cls"))
        columns = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows"))
        columns = columns.filter("lo <> hi").select("token", "rows")
        now = durable(now.select("token", "cls", "n", "left", "comp").join(columns, "token"))
        if now.isEmpty() and links is not None:
            break
        hubs = now
        if width:
            draw = F.pmod(F.xxhash64("cls", F.lit(turn)), F.lit(1 << 30)) * F.col("rows")
            hubs = now.filter(draw <= width * (1 << 30))
        pairs = side(now, "a").join(side(hubs, "b"), "token").filter("comp_a <> comp_b").filter(_may_reach(percent))
        if not width:
            pairs = pairs.filter("comp_a < comp_b")
        pairs = pairs.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b")).distinct()
        found = _linked(pairs, incidence, percent)
        links = durable(found if links is None else links.unionByName(found))
    return links


def ngram_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85
) -> DataFrame:
    """Per row: id, ``n_shingles`` and ``component_id``, the smallest id its links reach.

    Sets are distinct ``k``-word shingles of the whole lowered text; fewer words
    are one shingle. Two rows link when ``100 * overlap >= percent * union``; equal
    sets always do. A null, empty or blank text has no shingle and is its own
    component. Repeated rows are kept, each with its result; rows with a null id
    take part, but a component is named by an id that is not null where it has one.
    Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    classes = durable(shingle_classes(docs, "id", "text", k))
    nodes = components(class_links(docs, classes, k, percent).select("a", "b"))
    sets = classes.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("least"))
    sets = sets.join(nodes, sets["cls"] == nodes["node"], "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root")
    )
    named = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    sets = sets.join(named, "root").select("cls", "component_id")
    out = classes.join(sets, "cls", "left")
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
