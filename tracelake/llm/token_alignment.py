"""Alignment of the tokens that two tokenizers make of the same bytes, and how often token pairs meet in a corpus.

Both tokenizers encode a text with a space in front. A token ends at a byte offset; where both end, the text is cut into groups.
Common ends are found by galloping: the list with fewer ends drives an exponential and then a binary search into the other,
each search going on where the one before ended. Lanes of ``LANE`` ends of many texts gallop side by side. The common
indices slice the tokens into groups; what two lists' ranks advance by from one common end to the next is the group's
tokens on either side, and every token of one side is linked with every one of the other.

Pair counts say in how many documents a pair of ids is linked. Texts are taken in blocks; a block states each of its pairs
once, so a pair in every text costs a row per block, and the counts return to the blocks by the same rows.

Null and empty texts, and texts whose tokens' bytes do not spell the space and the text (U+2581 in a text, say), have no tokens.
Repeated rows are documents of their own, and rows may share an id. Very long texts are blocks of their own; a text's
links are held at once, LINKS at a time while they are listed. Special tokens' strings are plain text. An empty table gives no
rows. Kept columns pass through unless they are named like a result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import stored

#: Ends that one lane of a gallop goes through in order.
LANE = 64
#: Bytes of text aligned together, and encoded together.
BLOCK, ENCODED = 2 << 20, 1 << 16
#: Links listed at once.
LINKS = 1 << 22
#: Parts of texts remembered with their ids, and the longest of them.
MEMORY, SHORT = 100_000, 64
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_memory: dict[tuple[int, int], dict[str, tuple[tuple[int, ...], tuple[int, ...], bool]]] = {}
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
RESULTS = [*COUNTS, "n_best", "count_sum", "groups_sha256"]


class Entries:
    """The bytes of each id of a vocabulary and the ways its number is written in a group."""

    def __init__(self, spelled: dict[int, bytes], ends: tuple[bytes, bytes]):
        self.size = max(spelled) + 1
        self.spelled = [spelled.get(i, b"") for i in range(self.size)]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        self.written = np.array([f"{i}".encode() + end for end in ends for i in range(self.size)], object)

    def spell(self, ids: list[int]) -> bytes:
        return b"".join([self.spelled[i] for i in ids])


class ByteLevel(Entries):
    """A tokenizer file whose entries stand for bytes, each byte for one character."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # bytes without a visible character of their own take the characters from 256 on, in order
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        super().__init__({i: bytes(byte[c] for c in t) for t, i in self.model.get_vocab().items()}, (b",", b"|"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces(Entries):
    """A sentencepiece model, which puts the space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        spelled = {i: bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)}
        super().__init__(spelled, (b",", b";"))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def gallop(driving: np.ndarray, into: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each of the ascending ``driving`` values the place of the first value of ``into`` that is not smaller.

    ``begin`` is a place from which each may be sought. The last of ``into`` is not smaller than any of ``driving``.
    """
    found = np.zeros(len(driving), np.int64)
    lanes = np.arange(0, len(driving), LANE)
    now = begin[lanes].copy()
    for turn in range(min(LANE, len(driving))):
        lanes = lanes[: np.searchsorted(lanes, len(driving) - turn)]
        value, low = driving[lanes + turn], now[: len(lanes)]
        high = low.copy()
        open_ = np.flatnonzero(into[low] < value)
        low, step = low.copy(), 1
        going = open_
        while len(going):
            low[going] = high[going]
            high[going] = np.minimum(high[going] + step, len(into) - 1)
            step *= 2
            going = going[into[high[going]] < value[going]]
        going = open_[high[open_] - low[open_] > 1]
        while len(going):
            middle = (low[going] + high[going]) >> 1
            less = into[middle] < value[going]
            low[going[less]], high[going[~less]] = middle[less], middle[~less]
            going = going[high[going] - low[going] > 1]
        found[lanes + turn] = high
        now[: len(lanes)] = high
    return found


def encoded(parts: list[str], a: Entries, b: Entries) -> list[tuple[tuple[int, ...], tuple[int, ...], bool]]:
    """Of each distinct part its ids by either tokenizer and whether both spell it; up to ``MEMORY`` parts are remembered."""
    known = _memory.setdefault((id(a), id(b)), {})
    fresh = [p for p in parts if p not in known]
    edges = np.append(0, np.cumsum([len(p) + 1 for p in fresh]))
    for x, y in common.row_blocks(edges, ENCODED):
        for p, one, two in zip(fresh[x:y], a.encode(fresh[x:y]), b.encode(fresh[x:y])):
            said = b" " + p.encode()
            known[p] = (tuple(one), tuple(two), a.spell(one) == said and b.spell(two) == said)
    found = [known[p] for p in parts]
    if len(known) > MEMORY:
        known.clear()
    else:
        for p in fresh:
            if len(p) > SHORT:
                del known[p]
    return found


def _spread(ids: list[tuple[int, ...]], codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all parts in a row, given the ids of the distinct ones, and where each text's begin."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum()))
    own = sizes[codes]
    ends = np.cumsum(own)
    first = (np.cumsum(sizes) - sizes)[codes]
    return flat[np.repeat(first - ends + own, own) + np.arange(ends[-1] if len(ends) else 0)], np.append(0, ends)[at]


class Aligned:
    """Tokens and groups of a block of texts; arrays run over all its texts, ``at_`` says where a text's begin.

    No token of either tokenizer reaches over a single space between characters that are no white space. So texts are cut
    there and equal parts are encoded once.
    """

    def __init__(self, texts: list[str], a: Entries, b: Entries):
        number: dict[str, int] = {}
        cut = [_CUT.split(t) if t else [] for t in texts]
        codes = np.array([number.setdefault(p, len(number)) for own in cut for p in own], np.int64)
        at = np.append(0, np.cumsum([len(own) for own in cut])).astype(np.int64)
        parts = encoded(list(number), a, b)
        # a text with a part that either tokenizer does not spell has no tokens
        bad = ~np.array([p[2] for p in parts], bool)
        if bad.any():
            text = np.repeat(np.arange(len(texts)), np.diff(at))
            keep = ~np.isin(text, text[bad[codes]])
            codes, at = codes[keep], np.append(0, np.cumsum(np.bincount(text[keep], minlength=len(texts))))
        (self.a, self.at_a), (self.b, self.at_b) = (_spread([p[k] for p in parts], codes, at) for k in (0, 1))
        end_a, end_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        n_a, n_b = np.diff(self.at_a), np.diff(self.at_b)
        # the shorter list of a text drives: its tokens, then the other's, as places in the lists of A and B
        fewer = np.where(n_a <= n_b, n_a, n_b)
        swap = n_a > n_b
        own, other = self._side(swap), self._side(~swap)
        ends = np.append(end_a, end_b)
        driving, into = (ends[place + which * len(end_a)] for place, which in (own, other))
        starts = np.append(0, np.cumsum(n_a + n_b - fewer))[:-1]
        place = gallop(driving, into, np.repeat(starts, fewer)) if len(driving) else np.zeros(0, np.int64)
        common_ = np.flatnonzero(into[place] == driving) if len(driving) else np.zeros(0, np.int64)
        mine, theirs, swapped = own[0][common_], other[0][place[common_]], own[1][common_]
        self.cut_a, self.cut_b = np.where(swapped, theirs, mine) + 1, np.where(swapped, mine, theirs) + 1
        self.size_a, self.size_b = np.diff(self.cut_a, prepend=0), np.diff(self.cut_b, prepend=0)
        self.at_group = np.searchsorted(self.cut_a, self.at_a, "right")
        self.n_links = np.append(0, np.cumsum(self.size_a * self.size_b))

    def _side(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of each text's tokens in the list of A or, where told, of B; and which of them those are."""
        first = np.where(b, self.at_b[:-1], self.at_a[:-1])
        count = np.where(b, np.diff(self.at_b), np.diff(self.at_a))
        ends = np.cumsum(count)
        return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0), np.repeat(b, count)

    def written(self, a: Entries, b: Entries) -> list[bytes]:
        """Each text's groups: ids joined by commas, A's from B's by a bar, groups by semicolons."""
        n_a, n_b = len(self.a), len(self.b)
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.cut_a - 1] = last_b[self.cut_b - 1] = 1
        out = np.empty(n_a + n_b, object)
        before_b, before_a = np.repeat(self.cut_b - self.size_b, self.size_a), np.repeat(self.cut_a, self.size_b)
        out[np.arange(n_a) + before_b] = a.written[self.a + last_a * a.size]
        out[np.arange(n_b) + before_a] = b.written[self.b + last_b * b.size]
        at = self.at_a + self.at_b
        return [b"".join(out[x:y].tolist())[:-1] for x, y in zip(at, at[1:])]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, times, at): each text's distinct linked pairs as a * width + b, and how often it holds each."""
        found, counts, owners = [], [], []
        text = np.repeat(np.arange(len(self.at_group) - 1), np.diff(self.at_group))
        groups = len(self.size_a)
        x = 0
        while x < groups:
            y = max(x + 1, int(np.searchsorted(self.n_links, self.n_links[x] + LINKS, "right")) - 1)
            for one, two, who in self._linked(x, y, text):
                key = np.sort(who * self._span(width) + one * width + two)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                found.append(key[first] % self._span(width))
                owners.append(key[first] // self._span(width))
                counts.append(np.diff(np.append(first, len(key))))
            x = y
        pair, times, owner = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (found, counts, owners))
        if len(found) > 1:
            order = np.lexsort((pair, owner))
            pair, times, owner = pair[order], times[order], owner[order]
            first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])))
            pair, owner, times = pair[first], owner[first], np.add.reduceat(times, first)
        return pair, times, np.searchsorted(owner, np.arange(len(self.at_group)))

    def _span(self, width: int) -> int:
        return (int(self.a.max()) + 1) * width

    def _linked(self, x: int, y: int, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A id, B id, text) of the links of groups x to y; a group with very many comes in slices of its A tokens."""
        size_a, size_b = self.size_a[x:y], self.size_b[x:y]
        first_a, first_b = self.cut_a[x:y] - size_a, self.cut_b[x:y] - size_b
        if y == x + 1 and size_a[0] * size_b[0] > LINKS:
            own = self.b[first_b[0] : first_b[0] + size_b[0]]
            step = max(1, LINKS // len(own))
            for k in range(0, size_a[0], step):
                part = self.a[first_a[0] + k : first_a[0] + min(k + step, size_a[0])]
                yield np.repeat(part, len(own)), np.tile(own, len(part)), np.full(len(part) * len(own), text[x])
            return
        many = size_a * size_b
        ends = np.cumsum(many)
        inside = np.arange(ends[-1]) - np.repeat(ends - many, many)
        wide = np.repeat(size_b, many)
        yield self.a[np.repeat(first_a, many) + inside // wide], self.b[np.repeat(first_b, many) + inside % wide], np.repeat(text[x:y], many)


def _decoded(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.cast(pa.string()).to_pylist()]


def groups(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``groups``: of every row the aligned groups as text, ``a1,a2|b1;a3|b2,b3`` of decimal ids."""
    keep = [name for name in keep if name != "groups"]
    chosen = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        for batch, _, _ in _blocks(batches, len(keep)):
            said = Aligned(_decoded(batch.column(len(keep))), a, b).written(a, b)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([s.decode() for s in said], pa.string())], [*keep, "groups"])

    return chosen.mapInArrow(run, docs.select(*keep, F.lit("").alias("groups")).schema)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    for batch in batches:
        _, offsets = common.text_bytes(batch.column(column))
        for x, y in common.row_blocks(offsets, BLOCK):
            yield batch.slice(x, y - x), x, y


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(values.astype(np.int32).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.int32).astype(np.int64)


def linked(docs: DataFrame, a_path: str, b_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and of every row n_a, n_b, n_groups, n_links, n_best (links whose pair count is the highest of their A id),
    count_sum (pair counts over links) and the digest of its groups."""
    keep = [name for name in keep if name not in RESULTS]
    private = [f"_keep{k}" for k in range(len(keep))]
    chosen = docs.select(*[F.col(name).alias(p) for name, p in zip(keep, private)], F.col(text).alias("_text"))
    width = F.lit(0).cast("long")
    row = F.struct(*private, *[width.alias(n) for n in COUNTS], F.lit("").alias("groups_sha256"), width.alias("n_pairs"))
    schema = chosen.select(width.alias("block"), F.array(row).alias("docs"), F.array(width).alias("pairs"), F.array(width).alias("held"), F.lit(b"").alias("at"), F.lit(b"").alias("times")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieces(b_path)
        for number, (batch, _, _) in enumerate(_blocks(batches, len(private))):
            whole = Aligned(_decoded(batch.column(len(private))), a, b)
            pair, times, at = whole.pairs(b.size)
            distinct, back = np.unique(pair, return_inverse=True)
            # places grow within a text: differences compress well
            steps = np.diff(back, prepend=0)
            steps[at[:-1][np.diff(at) > 0]] = back[at[:-1][np.diff(at) > 0]]
            digests = [hashlib.sha256(s).hexdigest() if s else "" for s in whole.written(a, b)]
            counts = [np.diff(whole.at_a), np.diff(whole.at_b), np.diff(whole.at_group), np.diff(whole.n_links[whole.at_group])]
            columns = [*batch.columns[: len(private)], *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(np.diff(at), pa.int64())]
            rows = pa.StructArray.from_arrays(columns, [*private, *COUNTS, "groups_sha256", "n_pairs"])
            one = [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([distinct], pa.list_(pa.int64())),
                pa.array([np.bincount(back, minlength=len(distinct))], pa.list_(pa.int64())),
                pa.array([_packed(steps)], pa.binary()),
                pa.array([_packed(times)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(one, ["block", "docs", "pairs", "held", "at", "times"])

    blocks = stored(chosen.mapInArrow(run, schema), "aligned")
    told = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("k", "p")).select("block", "k", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = stored(told.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
    # one row for each id of the first vocabulary at most
    size = pieces(b_path).size
    first = F.call_function("div", "pair", F.lit(size))
    best = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    ranked = counts.join(F.broadcast(best), first == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    back = told.join(ranked, "pair").groupBy("block").agg(F.collect_list(F.struct("k", "n", "top")).alias("counts"))  # a block's pairs
    joined = blocks.drop("pairs", "held").join(back, "block", "left").select("block", "docs", "at", "times", "counts.k", "counts.n", "counts.top")
    fields = [*private, *RESULTS]
    result = F.struct(*private, *[width.alias(n) for n in RESULTS[:-1]], F.lit("").alias("groups_sha256"))
    # the join has dealt the blocks already; a group is one block, so no two of them are held together
    done = joined.groupBy("block").applyInArrow(_counted(private), chosen.select(result.alias("r")).select("r.*").schema)
    return done.select(*[F.col(f).alias(name) for f, name in zip(fields, [*keep, *RESULTS])])


def _counted(private: list[str]):
    def run(block: pa.Table) -> pa.Table:
        _, rows, at, times, place, n, top = (column.combine_chunks()[0] for column in block.columns)
        rows = rows.values
        sizes = np.asarray(rows.field("n_pairs").to_numpy(zero_copy_only=False), np.int64)
        steps, times = _unpacked(at.as_py(), int(sizes.sum())), _unpacked(times.as_py(), int(sizes.sum()))
        some = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[some]
        total = np.cumsum(steps)
        back = total - np.repeat(np.append(0, total)[first], sizes[some])
        sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
        if len(some):
            counts, best = np.zeros((2, 1 + int(back.max())), np.int64)
            where = place.values.to_numpy()
            counts[where], best[where] = n.values.to_numpy(), top.values.to_numpy(zero_copy_only=False)
            sums[0][some] = np.add.reduceat(times * best[back], first)
            sums[1][some] = np.add.reduceat(times * counts[back], first)
        columns = [rows.field(f) for f in [*private, *COUNTS]] + [pa.array(s) for s in sums] + [rows.field("groups_sha256")]
        return pa.Table.from_arrays(columns, [*private, *RESULTS])

    return run
