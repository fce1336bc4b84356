"""Substring deduplication: words inside a passage that an earlier document, or an earlier place of it, holds word for word.

Fixed-block anchors. Each text is cut into reference blocks of ``(window + 1) // 2`` words that do not overlap, so every window
holds a whole block, the first of which starts less than a block after the window. All blocks are indexed; every text probes
the index with every rolling run of that many words. A block that another place hits too is an anchor. Anchors are
extended to the windows around them, the windows are met by their words' hash, and those that start earlier elsewhere join
to maximal runs, which are removed.

Index and probes travel packed by hash range, each hash once for a run of texts, so that neither a frequent passage nor a large
group of copies fills one task, and no two copies are ever paired. The answer to the probes is a bitmap of ``filter_bits`` bits
that goes to all tasks. Its size is fixed: where two blocks share a bit more windows are met, and the result is the same.

A text's place is its id, then a hash of its text (rows that share an id but not the text are documents one after the other), and
null ids come last. Rows that repeat id and text are one document: each gets the same result. Null and empty texts have no
words; texts shorter than a window keep all. Very long texts are taken whole. An empty table gives no rows. Two different
windows share a hash with a chance of 2**-64 a pair. Kept columns pass through unless they are named like a result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import stored

_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bits of a run's hash, beside those that choose its range, by which index and probes meet.
MET = 32
RESULTS = ["n_words", "n_removed", "kept"]
TOLD = ["ids", "absent", "texts", "firsts"]


@dataclass(frozen=True)
class Dedup:
    """``window`` words decide; ``filter_bits`` bounds what is broadcast about anchors and changes no result."""

    window: int = 20
    filter_bits: int = 27

    @property
    def block(self) -> int:
        return (self.window + 1) // 2


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every ``width`` consecutive words."""
    n = len(words) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for k in range(width if n > 0 else 0):
        out = out * _STEP + words[k : k + n]
    return common.mix(out + np.uint64(width))


def _runs(at: np.ndarray, width: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``width`` words that lie in one text which has a window, and the place of each in its text."""
    sizes = np.diff(at)
    usable = np.where(sizes >= window, sizes - width + 1, 0)
    ends = np.cumsum(usable)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - usable, usable)
    return inside + np.repeat(at[:-1], usable), inside


def _ranges(docs: DataFrame, how: Dedup) -> int:
    """How many hash ranges: grows with the input, so that a range stays small."""
    ranges = 64
    while ranges < min(8 * docs.rdd.getNumPartitions(), 1 << (how.filter_bits - 6)):
        ranges *= 2
    return ranges


def anchors(docs: DataFrame, how: Dedup) -> np.ndarray:
    """A bit for the leading bits of the hash of each reference block that is met by more than itself."""
    ranges = _ranges(docs, how)
    bits = ranges.bit_length() - 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in common.blocks_of(batches, 0):
            words, at, _ = common.hash_words(data, offsets, lower=False)
            start, inside = _runs(at, how.block, how.window)
            # the last bit tells a reference block
            hashes = (rolled(words, how.block)[start] >> np.uint64(63 - bits - MET)) & ~np.uint64(1) | (inside % how.block == 0).astype(np.uint64)
            hashes, times = np.unique(hashes, return_counts=True)
            first = np.flatnonzero(np.append(True, hashes[1:] >> np.uint64(1) != hashes[:-1] >> np.uint64(1))) if len(hashes) else np.zeros(0, np.int64)
            held = np.minimum(np.add.reduceat(times, first), 2).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
            block = np.maximum.reduceat(hashes & np.uint64(1), first).astype(np.uint8) if len(first) else np.zeros(0, np.uint8)
            keys = hashes[first] >> np.uint64(1)
            cut = np.searchsorted(keys >> np.uint64(MET), np.arange(ranges + 1, dtype=np.uint64))
            short, kind = keys.astype(np.uint32), held | block << np.uint8(2)
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([short[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()),
                    pa.array([kind[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()),
                ],
                ["range", "keys", "kinds"],
            )

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(part["keys"]), np.uint32)
        kinds = np.frombuffer(b"".join(part["kinds"]), np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, kinds = keys[order], kinds[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        shared = (np.add.reduceat((kinds & 3).astype(np.int64), first) > 1) & (np.maximum.reduceat(kinds >> 2, first) > 0)
        bitmap = np.zeros(1 << (how.filter_bits - bits), bool)
        bitmap[(keys[first[shared]] >> np.uint32(MET + bits - how.filter_bits)).astype(np.int64)] = True
        return pd.DataFrame({"range": [part["range"].iloc[0]], "bits": [np.packbits(bitmap).tobytes()]})

    packed = docs.select(F.col("text").cast("binary")).mapInArrow(probe, "range long, keys binary, kinds binary")
    met = stored(packed.groupBy("range").applyInPandas(meet, "range long, bits binary"), "anchors")
    bitmap = np.zeros(1 << (how.filter_bits - 3), np.uint8)
    size = len(bitmap) >> bits
    for row in met.toLocalIterator():
        bitmap[row["range"] * size : (row["range"] + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def repeats(docs: DataFrame, how: Dedup = Dedup()) -> DataFrame:
    """(doc_id, text_hash, starts, stops): the maximal runs of words to remove, of documents that have any.

    Windows are met by ranges of their hash. A run of texts (a piece) sends each of its windows once, at its earliest place; the
    others are known to repeat. Rows of a piece itself pass under a key of their own.
    """
    spark, ranges = docs.sparkSession, _ranges(docs, how)
    bits = ranges.bit_length() - 1
    known = spark.sparkContext.broadcast(anchors(docs, how))
    # of each text in a message: id, whether that is null, hash, first word in the piece
    of_texts = "ids binary, absent binary, texts binary, firsts binary"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, pieces = known.value, 0
        for batch, data, offsets in common.blocks_of(batches, 2):
            words, at, _ = common.hash_words(data, offsets, lower=False)
            ids, texts = batch.column(0), batch.column(1).to_numpy()
            numbers, absent = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            start, inside = _runs(at, how.window, how.window)
            cell = (rolled(words, how.block)[start + (-inside) % how.block] >> np.uint64(64 - how.filter_bits)).astype(np.int64)
            hit = (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
            start, inside = start[hit], inside[hit]
            hashes = rolled(words, how.window)[start]
            row = np.searchsorted(at, start, "right") - 1
            # the order of the rows by place, equal for equal documents, of which one is enough
            by = np.lexsort((texts, numbers, absent))
            same = np.append(False, (texts[by][1:] == texts[by][:-1]) & (numbers[by][1:] == numbers[by][:-1]) & (absent[by][1:] == absent[by][:-1]))
            rank, twin = np.zeros(len(by), np.int64), np.zeros(len(by), bool)
            rank[by], twin[by] = np.arange(len(by)), same
            once = ~twin[row]
            hashes, start, inside, row = hashes[once], start[once], inside[once], row[once]
            order = np.lexsort((inside, rank[row], hashes))
            hashes, start = hashes[order], start[order]
            first = np.append(True, hashes[1:] != hashes[:-1]) if len(hashes) else np.zeros(0, bool)
            piece = TaskContext.get().partitionId() << 32 | pieces
            pieces += 1
            again, hashes, start = np.sort(start[~first]), hashes[first], start[first]
            if not len(hashes):
                continue
            cut = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(ranges + 1, dtype=np.uint64))
            told = [numbers.astype(np.int64), absent.astype(np.uint8), texts.astype(np.int64), at[:-1].astype(np.int64)]
            rows = [(-1 - piece, piece, b"", again.astype(np.int32).tobytes(), *(x.tobytes() for x in told))]
            for r in np.flatnonzero(np.diff(cut)):
                own = start[cut[r] : cut[r + 1]]
                used = np.unique(np.searchsorted(at, own, "right") - 1)
                rows.append((int(r), piece, hashes[cut[r] : cut[r + 1]].tobytes(), own.astype(np.int32).tobytes(), *(x[used].tobytes() for x in told)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SENT)], schema=_SENT)

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        if part["key"].iloc[0] < 0:
            return part[["piece", "starts", *TOLD]]
        hashes = np.frombuffer(b"".join(part["hashes"]), np.uint64)
        starts = [np.frombuffer(x, np.int32) for x in part["starts"]]
        sender = np.repeat(np.arange(len(part)), [len(x) for x in starts])
        absent, numbers, texts, inside = [], [], [], []
        for own, *told in zip(starts, *(part[n] for n in TOLD)):
            number, gone, hashed, first = (np.frombuffer(x, kind) for x, kind in zip(told, (np.int64, np.uint8, np.int64, np.int64)))
            at = np.searchsorted(first, own, "right") - 1
            absent.append(gone[at])
            numbers.append(number[at])
            texts.append(hashed[at])
            inside.append(own - first[at])
        absent, numbers, texts, inside, begun = map(np.concatenate, (absent, numbers, texts, inside, starts))
        order = np.lexsort((inside, texts, numbers, absent, hashes))
        fresh = np.append(True, hashes[order][1:] != hashes[order][:-1])
        lead = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        later = (absent[order] != absent[lead]) | (numbers[order] != numbers[lead]) | (texts[order] != texts[lead]) | (inside[order] != inside[lead])
        late = np.sort(order[later])
        cut = np.searchsorted(sender[late], np.arange(len(part) + 1))
        some = np.flatnonzero(np.diff(cut))
        said = [begun[late[cut[k] : cut[k + 1]]].astype(np.int32).tobytes() for k in some]
        return pd.DataFrame({"piece": part["piece"].to_numpy()[some], "starts": said, **{n: [b""] * len(some) for n in TOLD}})

    def assemble(part: pd.DataFrame) -> pd.DataFrame:
        starts = np.unique(np.frombuffer(b"".join(part["starts"]), np.int32).astype(np.int64))
        whole = part.iloc[int(np.argmax([len(f) for f in part["firsts"]]))]
        number, gone, hashed, firsts = (np.frombuffer(whole[n], kind) for n, kind in zip(TOLD, (np.int64, np.uint8, np.int64, np.int64)))
        row = np.searchsorted(firsts, starts, "right") - 1
        out = []
        for own, k in zip(np.split(starts, np.flatnonzero(np.diff(row)) + 1), np.unique(row)):
            own = own - firsts[k]
            gap = np.append(True, own[1:] - own[:-1] > how.window)
            ends = np.append(own[np.flatnonzero(gap)[1:] - 1], own[-1]) + how.window
            out.append((None if gone[k] else int(number[k]), int(hashed[k]), own[gap].tolist(), ends.tolist()))
        return pd.DataFrame(out, columns=["doc_id", "text_hash", "starts", "stops"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    windows = rows.mapInArrow(extend, f"key long, piece long, hashes binary, starts binary, {of_texts}")
    judged = windows.groupBy("key").applyInPandas(judge, f"piece long, starts binary, {of_texts}")
    found = judged.groupBy("piece").applyInPandas(assemble, "doc_id long, text_hash long, starts array<long>, stops array<long>")
    return found.dropDuplicates(["doc_id", "text_hash"])


_SENT = pa.schema(
    [("key", pa.int64()), ("piece", pa.int64()), ("hashes", pa.binary()), ("starts", pa.binary())] + [(n, pa.binary()) for n in TOLD]
)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words, number removed and the kept words of each text."""
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, starts, stops in zip(*(batch.column(k) for k in range(3))):
            words = _WORD.findall(text.as_py() or b"")
            counts.append(len(words))
            for a, b in zip(reversed(starts.as_py() or []), reversed(stops.as_py() or [])):
                del words[a:b]
            removed.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode("utf-8", "replace"))
        columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), *batch.columns[3:]]
        yield pa.RecordBatch.from_arrays(columns, [*RESULTS, *batch.schema.names[3:]])


def deduplicate(docs: DataFrame, keep: list[str], how: Dedup = Dedup()) -> DataFrame:
    """``keep``, n_words, n_removed and ``kept``: the words that stay, joined by one space, for every row."""
    keep = [name for name in keep if name not in RESULTS]
    found = repeats(docs, how).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "starts", "stops")
    private = [F.col(name).alias(f"_keep{k}") for k, name in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_own"), F.col("text").cast("binary").alias("_text"), *private)
    joined = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    chosen = joined.select("_text", "starts", "stops", *[f"_keep{k}" for k in range(len(keep))])
    schema = chosen.select(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept"), *[f"_keep{k}" for k in range(len(keep))]).schema
    done = chosen.mapInArrow(_kept, schema)
    return done.select(*[F.col(f"_keep{k}").alias(name) for k, name in enumerate(keep)], *RESULTS)
