"""Ranked lexical search by pipelined term partitioning.

The terms of the items are dealt to owners by rarity, rarest first. Documents are read
once, into blocks; a block keeps the postings of the items' terms only. An item bundle
holds some items and a sparse accumulator (item, document, score) for one block. It
visits the owners in turn: a cogroup brings it together with that owner's postings of
its block, and integer contributions are added.

Between two owners the ``k``-th best score so far of every item is taken over all
blocks. A document that cannot reach it any more, whatever the owners ahead add, leaves
the accumulator. This never changes the result: ``k`` documents stay that are better.

No step holds more than a block's documents times a bundle's items. An owner has at
most ``OWNED`` terms, and that is all that is sent to the tasks; a larger vocabulary
makes more owners and more passes over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable
from . import words

OWNED = 500_000  # terms of one owner
RARITY = (256, 32, 4)  # owners: terms in at most a 256th, a 32nd, a 4th of the documents, and the others
ITEMS = 128  # items of a bundle, about
BLOCK_BYTES = 8 << 20

_TERM = np.ones(256, dtype=bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_first : _last + 1] = False

_BUNDLE = (
    "chunk int, block long, items array<long>, cuts array<int>, terms array<int>, stages array<int>, bounds array<long>, "
    "ids array<long>, known array<boolean>, "
    "acc_item array<int>, acc_doc array<int>, acc_score array<long>, best_item array<int>, best_score array<long>"
)


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every term, and the terms before each row (one more than rows)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _TERM[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A term's name: 64 bits of its lowered bytes and their number."""
    return words.mix(words.hashes(data, starts, ends) + (ends - starts).astype(np.uint64)).view(np.int64)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def contributions(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """w * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 10 + (90 * n * n_docs) div all_terms."""
    if len(n) and 90 * n_docs * int(n.max()) >= 1 << 62:
        m = np.array([10 + 90 * n_docs * int(x) // all_terms for x in n], dtype=np.int64)
    else:
        m = 10 + (90 * n_docs * n) // max(1, all_terms)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, name): the distinct terms of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, last, data, offsets in words.chunks(batch.column(1)):
                starts, ends, rows = spans(data, offsets)
                who = np.repeat(ids[first:last], np.diff(rows))
                yield pa.RecordBatch.from_pydict({"item": pa.array(who, pa.int64()), "name": names(data, starts, ends)})

    picked = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return picked.filter("item IS NOT NULL").mapInArrow(run, "item long, name long").distinct()


def _blocks(docs: DataFrame, id_col: str, text_col: str, names_known: np.ndarray, first_term: int) -> DataFrame:
    """(block, ids, known, n, term, doc, tf): postings of the ``names_known`` (ascending) in blocks of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, data, offsets in words.chunks(batch.column(1), BLOCK_BYTES):
                starts, ends, rows = spans(data, offsets)
                n = np.diff(rows)
                found = names(data, starts, ends)
                at = np.minimum(np.searchsorted(names_known, found), max(0, len(names_known) - 1))
                hit = names_known[at] == found if len(names_known) else np.zeros(len(found), dtype=bool)
                ids = batch.column(0).slice(first, last - first)
                pair = at[hit].astype(np.int64) * (last - first) + np.repeat(np.arange(last - first), n)[hit]
                pair, tf = np.unique(pair, return_counts=True)
                lists = {
                    "ids": (ids.fill_null(0), pa.int64()), "known": (ids.is_valid(), pa.bool_()), "n": (n, pa.int64()),
                    "term": (pair // (last - first) + first_term, pa.int32()), "doc": (pair % (last - first), pa.int32()),
                    "tf": (tf, pa.int64()),
                }
                row = {"block": pa.array([(part << 33) + count], pa.int64())}
                for name, (values, kind) in lists.items():
                    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
                    row[name] = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_pydict(row)
                count += 1

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(
        run, "block long, ids array<long>, known array<boolean>, n array<long>, term array<int>, doc array<int>, tf array<long>"
    )


def _owned(found: DataFrame, terms: np.ndarray, w: np.ndarray, n_docs: int, all_terms: int) -> DataFrame:
    """(block, term, doc, add): what one owner adds, ascending by term. ``terms`` ascend."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                term, doc, tf, n = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("term", "doc", "tf", "n"))
                at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                own = terms[at] == term
                if own.any():
                    add = contributions(w[at[own]], tf[own], n[doc[own]], n_docs, all_terms)
                    yield pa.RecordBatch.from_pydict({
                        "block": pa.array([batch.column("block")[i].as_py()], pa.int64()), "term": pa.array([term[own]], pa.list_(pa.int32())),
                        "doc": pa.array([doc[own]], pa.list_(pa.int32())), "add": pa.array([add], pa.list_(pa.int64())),
                    })

    return found.select("block", "n", "term", "doc", "tf").mapInArrow(run, "block long, term array<int>, doc array<int>, add array<long>")


def _top(item: np.ndarray, doc_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of every item: highest score, then smallest id."""
    order = np.lexsort((doc_id, -score, item))
    own = item[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff([*first, len(own)]))
    return order[rank < k]


def _visit(stage: int, k: int):
    """The cogrouped step of one owner."""

    def run(_key, bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        out = []
        for b in bundles.itertuples(index=False):
            wide, pair_item = len(b.ids), np.repeat(np.arange(len(b.items)), np.diff(b.cuts))
            score = np.zeros(len(b.items) * wide, dtype=np.int64)
            score[np.asarray(b.acc_item, np.int64) * wide + b.acc_doc] = b.acc_score
            mine = b.stages == stage
            for p in postings.itertuples(index=False):
                low = np.searchsorted(p.term, b.terms[mine], side="left")
                many = np.searchsorted(p.term, b.terms[mine], side="right") - low
                at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
                np.add.at(score, np.repeat(pair_item[mine], many) * wide + p.doc[at], p.add[at])
            ahead = np.zeros(len(b.items), dtype=np.int64)
            np.add.at(ahead, pair_item, np.where(b.stages > stage, b.bounds, 0))
            reach = score + np.repeat(ahead, wide) >= np.repeat(b.least, wide)
            held = np.flatnonzero((score > 0) & np.tile(b.known, len(b.items)) & reach)
            item, doc, got = held // wide, held % wide, score[held]
            best = _top(item, b.ids[doc], got, k)
            out.append((
                b.chunk, b.block, b.items, b.cuts, b.terms, b.stages, b.bounds, b.ids, b.known,
                item, doc, got, item[best], got[best],
            ))
        return pd.DataFrame(out, columns=[f.split()[0] for f in _BUNDLE.split(", ")])

    return run


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, with a score above 0.

    Terms are runs of ASCII letters and digits and of all other characters from U+0080 on,
    with A-Z lowered. The score is a BM25 in integers (see ``weight`` and ``contributions``).
    Every row of ``docs`` is a document; a null or empty text has no terms and is no document
    of the counts. A document with a null id counts but is never returned. Rows of ``items``
    with the same id are one item; a null id takes no part. Equal scores go by ascending id;
    rows that repeat an id are ranked one by one. Other columns are ignored. Without documents
    or items the result is empty.
    """
    spark = docs.sparkSession
    asked = durable(_item_terms(items, item_id, item_text))
    distinct = asked.select("name").distinct()
    slices = max(1, -(-distinct.count() // OWNED))
    if slices > 1:  # every slice must meet the same blocks
        docs = durable(docs.select(doc_id, doc_text))
    by_name = Window.partitionBy("slice").orderBy("name")
    vocabulary = distinct.withColumn("slice", F.pmod("name", F.lit(slices)).cast("int"))
    vocabulary = durable(vocabulary.withColumn("place", F.row_number().over(by_name) - 1))
    found, term, before = None, F.lit(0), 0
    for s in range(slices):
        known = [r[0] for r in vocabulary.filter(F.col("slice") == s).select("name").collect()]
        # a job of its own each: blocks are named by task and place in it
        one = durable(_blocks(docs, doc_id, doc_text, np.array(sorted(known), dtype=np.int64), before).withColumn("slice", F.lit(s)))
        found = one if found is None else found.unionByName(one)
        term = F.when(F.col("slice") == s, F.col("place") + before).otherwise(term)
        before += len(known)
    vocabulary = vocabulary.withColumn("term", term.cast("int"))
    whole = found.filter("slice = 0")
    sizes = whole.select(F.explode("n").alias("n")).filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs, all_terms = int(sizes[0]), int(sizes[1])

    df = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = durable(df.withColumn("rarity", sum((F.col("df") * r > n_docs).cast("int") for r in RARITY)))
    sizes = {r["rarity"]: r["n"] for r in df.groupBy("rarity").agg(F.count("*").alias("n")).collect()}
    stage, stages = F.lit(-1), 0
    for rarity in sorted(sizes):
        owners = -(-sizes[rarity] // OWNED)
        stage = F.when(F.col("rarity") == rarity, F.pmod(F.xxhash64("term"), F.lit(owners)).cast("int") + stages).otherwise(stage)
        stages += owners
    # most that a term can add: less than 10**6 times its weight
    bound = F.ceil(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))) * 1_000_000
    df = df.select("term", "df", stage.alias("stage"), bound.cast("long").alias("bound"))

    chunks = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    named = asked.join(vocabulary.select("name", "term"), "name").join(df, "term")
    grouped = named.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "stage", "bound"))).alias("terms"))
    chunk = F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int").alias("chunk")
    grouped = grouped.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("item", "terms"))).alias("all"))
    ends = F.aggregate("all.terms", F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.size(t))))
    grouped = grouped.select("chunk", F.col("all.item").alias("items"), ends.alias("cuts"), F.flatten("all.terms").alias("t"))
    grouped = durable(grouped.select("chunk", "items", "cuts", F.col("t.term").alias("terms"), F.col("t.stage").alias("stages"), F.col("t.bound").alias("bounds")))

    def empty(kind: str) -> F.Column:
        return F.array().cast(f"array<{kind}>")

    # every item sets out in every block
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    bundles = whole.select("block", "ids", "known", every).join(grouped, "chunk").select(
        "*", empty("int").alias("acc_item"), empty("int").alias("acc_doc"), empty("long").alias("acc_score"),
        F.transform("items", lambda _: F.lit(0).cast("long")).alias("least"),
    )
    result = None
    for i in range(stages):
        rows = df.filter(F.col("stage") == i).select("term", "df").collect()
        own = np.array(sorted((r["term"], weight(n_docs, r["df"])) for r in rows), dtype=np.int64).reshape(-1, 2)
        postings = _owned(found, own[:, 0].copy(), own[:, 1].copy(), n_docs, all_terms).select("*", every)
        visited = bundles.groupBy("block", "chunk").cogroup(postings.groupBy("block", "chunk"))
        result = durable(visited.applyInPandas(_visit(i, k), _BUNDLE))
        if i + 1 < stages:
            scores = result.select("chunk", F.explode(F.arrays_zip("best_item", "best_score")).alias("b")).select("chunk", "b.*")
            by_item = Window.partitionBy("chunk", "best_item").orderBy(F.col("best_score").desc())
            kth = scores.withColumn("r", F.row_number().over(by_item)).filter(F.col("r") <= k).filter(F.col("r") == k)
            kth = kth.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("best_item", "best_score"))).alias("kth"))
            least = F.transform("items", lambda _, j: F.coalesce(F.element_at("kth", j.cast("int")), F.lit(0).cast("long")))
            bundles = result.drop("best_item", "best_score").join(kth, "chunk", "left").withColumn("least", least).drop("kth")
    if result is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                items_, ids, item, doc, score = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("items", "ids", "acc_item", "acc_doc", "acc_score")
                )
                best = _top(item, ids[doc], score, k)
                yield pa.RecordBatch.from_pydict({
                    "item_id": pa.array(items_[item[best]], pa.int64()), "doc_id": pa.array(ids[doc[best]].astype(np.int64), pa.int64()),
                    "score": pa.array(score[best], pa.int64()),
                })

    named = result.select("items", "ids", "acc_item", "acc_doc", "acc_score").mapInArrow(last, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
