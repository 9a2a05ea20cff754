"""Line dedup by a sharded minimal perfect hash over the distinct line hashes.

1. Keys of lines are hashed (128 bits) and counted over all documents by one
   grouped sum with partial sums, so a line of every document is one row.
2. The distinct hashes are dealt to shards of about ``SHARD`` keys. A shard is a
   minimal perfect hash: levels of bit arrays in which a key claims a bit that no
   other key of the level hits; the number of set bits before it is its slot.
   Slots index a 16-bit fingerprint array and a byte of the count (cut at the
   threshold); the largest document id is kept for the slots that reach it.
3. Documents send their line hashes to the shards, in salted parts, and probe the
   arrays. How many parts a shard needs follows from the counts, so a shard with
   a line that a third of all documents have is only probed by more tasks. Every
   probe is of a key the shard holds, so slots are exact; the fingerprint is
   checked all the same, and a mismatch ends the job.
4. The hashes to drop go back to their documents, and the lines are filtered there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .words import mix

SHARD = 250_000
PART = 500_000
_GAMMA = 1.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WHITE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _LOWER)


def _line_hash(line: Column, min_chars: int) -> Column:
    """Two independent 64-bit hashes of the key; null for a key that is too short."""
    key = line_key(line)
    return F.when(
        F.char_length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))
    )


# --- the index of one shard ---------------------------------------------------


def _level_hash(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix(a ^ mix(b + np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))))


def build_index(a: np.ndarray, b: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of all levels, bit size of each level, and the slot of every key. Keys are distinct."""
    rest, level, bits, sizes, found = np.arange(len(a)), 0, [], [], np.zeros(len(a), dtype=np.int64)
    base = 0
    while len(rest):
        size = max(8, int(len(rest) * _GAMMA) // 8 * 8 + 8)
        at = (_level_hash(a[rest], b[rest], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        own = alone[at]
        found[rest[own]] = base + at[own]
        bits.append(np.packbits(alone))
        sizes.append(size)
        rest, base, level = rest[~own], base + size, level + 1
    packed = np.concatenate(bits) if bits else np.zeros(0, dtype=np.uint8)
    before = np.concatenate([[0], np.cumsum(np.unpackbits(packed), dtype=np.int64)])
    return packed.tobytes(), np.array(sizes, dtype=np.int64), before[found]


def probe_index(packed: bytes, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots of the keys; -1 for a key that no level claims."""
    flat = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
    before = np.concatenate([[0], np.cumsum(flat, dtype=np.int64)])
    slots, rest, base = np.full(len(a), -1, dtype=np.int64), np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        if not len(rest):
            break
        at = base + (_level_hash(a[rest], b[rest], level) % np.uint64(size)).astype(np.int64)
        own = flat[at] == 1
        slots[rest[own]] = before[at[own]]
        rest, base = rest[~own], base + int(size)
    return slots


def _index(counts: DataFrame, min_docs: int) -> DataFrame:
    def build(group: pd.DataFrame) -> pd.DataFrame:
        a, b = (group[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        packed, sizes, slots = build_index(a, b)
        prints, often = np.zeros(len(a), dtype=np.uint16), np.zeros(len(a), dtype=np.uint8)
        prints[slots] = (b & np.uint64(0xFFFF)).astype(np.uint16)
        often[slots] = np.minimum(group["n"].to_numpy(), min_docs)
        last = np.zeros(len(a), dtype=np.int64)
        known = np.zeros(len(a), dtype=np.uint8)
        last[slots] = group["last"].to_numpy()
        known[slots] = group["known"].to_numpy()
        reach = often == min_docs
        return pd.DataFrame({
            "shard": [group["shard"].iloc[0]], "bits": [packed], "sizes": [sizes.tobytes()], "prints": [prints.tobytes()],
            "counts": [often.tobytes()], "last": [last[reach].tobytes()], "known": [known[reach].tobytes()],
        })

    return counts.groupBy("shard").applyInPandas(
        build, "shard long, bits binary, sizes binary, prints binary, counts binary, last binary, known binary"
    )


def _probe(min_docs: int):
    def run(_key, asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked[["id", "named", "text_hash", "a", "b"]]
        one = shard.iloc[0]
        a, b = (asked[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        slots = probe_index(one["bits"], np.frombuffer(one["sizes"], dtype=np.int64), a, b)
        prints = np.frombuffer(one["prints"], dtype=np.uint16)
        if (slots < 0).any() or (prints[slots] != (b & np.uint64(0xFFFF)).astype(np.uint16)).any():
            raise RuntimeError("a line hash is not in its shard")
        reach = np.frombuffer(one["counts"], dtype=np.uint8) == min_docs
        place = np.cumsum(reach) - 1
        last, known = np.frombuffer(one["last"], dtype=np.int64), np.frombuffer(one["known"], dtype=np.uint8)
        hit = np.flatnonzero(reach[slots])
        own = place[slots[hit]]
        largest = asked["named"].to_numpy()[hit] & (asked["id"].to_numpy()[hit] == last[own])
        drop = (known[own] == 1) & ~largest
        return asked.iloc[hit[drop]][["id", "named", "text_hash", "a", "b"]]

    return run


def repeated_lines(
    docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int
) -> DataFrame:
    """(id, text_hash, drops): the line hashes each document loses."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = F.array_distinct(F.filter(F.transform(F.split(text, "\n", -1), lambda x: _line_hash(x, min_chars)), lambda h: h.isNotNull()))
    lines = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.explode(hashed).alias("h"))
    # no null ids from here on: pandas would turn the column into doubles
    named = F.col("id").isNotNull().alias("named")
    lines = durable(lines.select(F.coalesce("id", F.lit(0)).alias("id"), named, "text_hash", "h.a", "h.b"))
    own = F.when(F.col("named"), F.col("id"))
    counts = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(own).alias("last"))
    counts = durable(counts.select("a", "b", "n", F.coalesce("last", F.lit(0)).alias("last"), F.col("last").isNotNull().alias("known")))
    shards = -(-counts.count() // SHARD) or 1
    shards = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = F.pmod("a", F.lit(shards)).alias("shard")
    index = _index(counts.select("*", shard), min_docs)

    # parts of a shard by its number of probes; one row a shard, 16 bytes each
    parts = counts.groupBy(shard).agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    parts = durable(parts)
    asked = lines.select("*", shard).join(F.broadcast(parts), "shard")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "named", "text_hash"), "parts").cast("int")).drop("parts")
    index = index.join(F.broadcast(parts), "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    dropped = asked.groupBy("shard", "part").cogroup(index.groupBy("shard", "part")).applyInPandas(
        _probe(min_docs), "id long, named boolean, text_hash long, a long, b long"
    )
    dropped = dropped.select(F.when(F.col("named"), F.col("id")).alias("id"), "text_hash", "a", "b")
    return dropped.groupBy("id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("drops"))  # lines of one text


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """``docs`` with ``text_col`` rebuilt from the lines that stay, and ``n_lines``, ``n_dropped``.

    A line's key is the line without white space at both ends, A-Z lowered. A key
    of at least ``min_chars`` code points that at least ``min_docs`` rows hold loses
    all its lines, repeats inside a row included, except in the row with the
    largest id. A null or empty text is one empty line. Rows that repeat an id
    count as documents of their own; rows with a null id count too but are never
    the largest, and where all holders have a null id all keep the line. Other
    columns pass through; two that are named ``n_lines`` or ``n_dropped`` are
    replaced. An empty table gives an empty result.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    drops = drops.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("drops").alias("_drops"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_own"),
        text.alias("_text"), F.xxhash64(text).alias("_text_hash"),
    )
    rows = rows.join(drops, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    lines = F.split("_text", "\n", -1)
    gone = lambda x: F.coalesce(F.array_contains("_drops", _line_hash(x, min_chars)), F.lit(False))
    rows = rows.withColumn("_kept", F.when(F.col("_drops").isNotNull(), F.filter(lines, lambda x: ~gone(x))))
    n = F.size(lines).cast("long")
    added = {
        text_col: F.when(F.col("_kept").isNull(), F.col("_text")).otherwise(F.array_join("_kept", "\n")),
        "n_lines": n,
        "n_dropped": F.when(F.col("_kept").isNull(), F.lit(0)).otherwise(n - F.size("_kept")).cast("long"),
    }
    names = list(dict.fromkeys([*docs.columns, *added]))
    return rows.select(*[(added[c] if c in added else F.col("_row")[c]).alias(c) for c in names])
