"""What several operators share: folds, stored steps, byte-level word hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes hashed at once: bounds the working memory of a task, whatever the length of a text.
CHUNK = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Shape of a byte: A for capitals, a for other letters (and bytes of non-ASCII letters), 9 for digits, else itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 57
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, k: int) -> Column:
    """crc32 of the key as text, mod k; null for a null key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(k))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offset where each row starts; null counts as empty."""
    flat = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(flat) else np.zeros(0, np.uint8)
    return data, offsets - (offsets[0] if len(offsets) else 0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finishing rounds that spread every bit of a 64-bit value."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _pow(kind: str, n: int) -> np.ndarray:
    """Powers of the base, or of its inverse, mod 2**64."""
    if len(_powers.get(kind, ())) < n:
        steps = np.full(max(n, CHUNK + 1), _BASE if kind == "up" else _BACK, np.uint64)
        steps[0] = 1
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def _hash_runs(values: np.ndarray, rank: np.ndarray | None, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:stop] for each pair; rank numbers the values that count (None: all do)."""
    at = np.arange(len(values)) if rank is None else rank
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _pow("up", len(values) + 1)[at] * (np.uint64(1) if rank is None else values != 0), out=sums[1:])
    first = start if rank is None else at[start]
    return mix((sums[stop] - sums[start]) * _pow("down", len(values) + 1)[first])


def hash_words(data: np.ndarray, offsets: np.ndarray, shapes: bool = False, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Words (runs without ASCII white space; A-Z lower-cased unless told otherwise) of all rows as 64-bit hashes, where
    each row's words start, and on request a hash of each word's shape (kinds of character, repeats collapsed).

    Works through the bytes in pieces of CHUNK cut at white space. Equal words get equal hashes; two different
    words share one with a chance of 2**-64 a pair.
    """
    hashes, forms, starts = [], [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = 0
    while begin < len(data):
        end = min(begin + CHUNK, len(data))
        while end < len(data):
            gaps = np.flatnonzero(_SPACE[data[begin:end]])
            if len(gaps):
                end = begin + int(gaps[-1]) + 1
                break
            end = min(end + CHUNK, len(data))
        part = data[begin:end]
        inside = ~_SPACE[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[begin + 1 : end]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[begin + 1 : end]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(_hash_runs(_FOLD[part] if lower else part, None, a, b))
        starts.append(a + begin)
        if shapes:
            kinds = _SHAPE[part]
            kept = first.copy()
            kept[1:] |= inside[1:] & (kinds[1:] != kinds[:-1])
            rank = np.cumsum(kept) - kept
            forms.append(_hash_runs(np.where(kept, kinds, 0).astype(np.uint8), rank, a, b))
        begin = end
    at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return h, np.searchsorted(at, offsets), (np.concatenate(forms) if forms else np.zeros(0, np.uint64)) if shapes else None


def row_blocks(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together; a longer row stands alone."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def blocks_of(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut into runs of rows of limited text, each with the bytes and offsets of its text column."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for a, b in row_blocks(offsets, most):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def row_of(offsets: np.ndarray) -> np.ndarray:
    """For each item the row it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest node reachable over the edges (src, dst), for every node that has one.

    ``known`` is the answer for earlier edges, which count too: only edges between its components are looked at, and it is
    returned itself if there are none. Each round every node takes the first of itself and its neighbours, then what that one
    took, and nodes that took the same one become one; the order is a hash, drawn anew every third round. A good share of the
    nodes goes in a round, and with them the edges inside, so that the joins of all rounds together stay linear in the edges. A
    node with very many links is no single group.
    """
    if known is not None:
        for name in ("src", "dst"):
            own = known.select(F.col("node").alias(name), F.col("component").alias("_c"))
            edges = edges.join(own, name, "left").withColumn(name, F.coalesce("_c", name)).drop("_c")

    def apart(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()

    left = edges = stored(apart(edges, "src", "dst"), "links")
    taken: list[DataFrame] = []
    while not left.isEmpty():
        turn = F.lit(len(taken) // 3)
        both = edges.union(edges.select("v", "u"))
        first = both.groupBy("u").agg(F.min_by("v", F.xxhash64(turn, "v")).alias("v"))
        own = F.xxhash64(turn, "u") < F.xxhash64(turn, "v")
        first = first.select(F.col("u").alias("node"), F.when(own, F.col("u")).otherwise(F.col("v")).alias("component"))
        first = _through(first, first)
        for name in ("u", "v"):
            edges = edges.join(first.withColumnsRenamed({"node": name, "component": f"{name}_to"}), name)
        edges = stored(edges.select("u", "v", "u_to", "v_to"), "links")
        taken.append(edges.select(F.col("u").alias("node"), F.col("u_to").alias("component")).union(edges.select("v", "v_to")).distinct())
        left, edges = edges.where("u_to <> v_to"), apart(edges, "u_to", "v_to")
    if not taken:
        return known if known is not None else edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = taken.pop()
    while taken:
        found = _through(taken.pop(), found)
    low = found.groupBy("component").agg(F.min("node").alias("low"))
    found = found.join(low, "component").select("node", F.col("low").alias("component"))
    if known is None:
        return found
    return _through(known, found).union(found.join(known.select("node"), "node", "left_anti"))


def _through(early: DataFrame, late: DataFrame) -> DataFrame:
    """The nodes of ``early`` with what ``late`` makes of their component, if it does."""
    to = late.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return early.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
