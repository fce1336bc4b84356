"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across, and equal parts of a block of rows are encoded once. All
distinct parts lie in one flat array of symbols. A round takes each part's pair of the best score, merges every
occurrence of it from the left at once, and drops the parts that have no pair left. Symbols outside the vocabulary
become bytes. Decoding gathers the bytes of the pieces.

Null counts as the empty text, which has no ids. Repeated rows get equal results, and an empty table gives no rows. Very long texts are blocks of their own. A model must be BPE with identity
normalisation; its path is a parameter. Other columns pass through or stay out, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import row_blocks, text_bytes

SPACE = "▁"
NONE = np.iinfo(np.int32).max
#: Parts with more symbols are merged with a queue, as they may need a round for each merge.
LONG = 400
#: Bytes of text taken together: more find more equal parts, and need more memory.
BLOCK = 1 << 20
_PARTS = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class Pieces:
    """What encoding needs of a model: symbols, ranks of pairs, bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  ﬁ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}ﬁ":
            raise ValueError("only models with identity normalisation and a space before the text are supported")
        size = self.size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        self.bytes = np.full(256, -1, np.int64)
        for i in byte_ids:
            self.bytes[int(pieces[i][1:-1], 16)] = i
        plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(a != SPACE and b in (SPACE, "\n") or a == "\n" for p in plain for a, b in zip(p, p[1:])):
            raise ValueError("a piece reaches over the start of a word")
        chars = sorted({c for p in plain for c in p})
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        self.symbols = np.array([plain.get(c, size + k) for k, c in enumerate(chars)], np.int64)
        # 0 is the best score; equal scores share a rank
        levels = np.unique([-model.get_score(i) for i in plain.values()], return_inverse=True)[1]
        rank = dict(zip(plain.values(), (int(x) for x in levels)))
        ties = np.bincount(levels) > 1
        symbol = {**dict(zip(chars, (int(s) for s in self.symbols))), **plain}
        self.one_by_one = np.append(ties, False)
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
                    # a merge can open a better pair: then other occurrences of its own pair have to wait
                    for part in (p[:k], p[k:]):
                        if len(part) > 1 and rank[plain[part]] >= rank[i]:
                            self.one_by_one[rank[plain[part]]] = True
        self.pairs = {ab: (rank[i], i) for ab, i in pairs.items()}
        self.width = size + len(chars) + 1
        keys = np.array([a * self.width + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        made = np.array(list(pairs.values()), np.int64)[order]
        self.keys, self.made = np.append(keys[order], -1), np.append(made, -1)
        self.ranks = np.append(np.array([rank[int(i)] for i in made], np.int32), NONE).astype(np.int32)
        shown = [b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.shown, self.opens = shown, np.array([p.startswith(SPACE) and i in rank for i, p in enumerate(pieces)])
        self.silent = np.array([not x for x in shown])

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no such piece) and result of merging each pair; symbols below 0 never merge."""
        key = a * self.width + b
        at = np.searchsorted(self.keys[:-1], key)
        at[(self.keys[at] != key) | (a < 0) | (b < 0)] = len(self.keys) - 1
        return self.ranks[at], self.made[at]


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _queued(symbols: list[int], p: Pieces) -> list[tuple[int, int]]:
    """(symbol, place) of one long part after its merges, taken best and leftmost first from a queue."""
    n = len(symbols)
    sym, after, before = [*symbols], [*range(1, n + 1)], [*range(-1, n - 1)]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (found := p.pairs.get((sym[i], sym[after[i]]))):
            heapq.heappush(heap, (found[0], i, sym[i], sym[after[i]], found[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        if sym[i] != a or after[i] >= n or sym[after[i]] != b:
            continue
        gone = after[i]
        sym[i], sym[gone], after[i] = made, -2, after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append((sym[i], i))
        i = after[i]
    return out


def encode_parts(parts: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all parts and where each part's begin."""
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.minimum(np.searchsorted(p.chars, points), len(p.chars) - 1)
    sym = np.where(p.chars[at] == points, p.symbols[at], -1)
    part, place = np.repeat(np.arange(len(parts)), sizes), np.arange(len(points))
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if (sizes > LONG).any():
        starts = np.cumsum(sizes) - sizes
        for i in np.flatnonzero(sizes > LONG):
            found = np.array(_queued(sym[starts[i] : starts[i] + sizes[i]].tolist(), p), np.int64)
            done.append((found[:, 0], np.full(len(found), i), found[:, 1] + starts[i]))
        short = sizes[part] <= LONG
        sym, part, place = sym[short], part[short], place[short]

    def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that start at places i; none reaches over the end of a part."""
        j = np.minimum(i + 1, len(sym) - 1)
        inside = (j > i) & (part[j] == part[i])
        return p.look_up(np.where(inside, sym[i], -1), sym[j])

    rank, made = ranked(np.arange(len(sym)))
    while len(sym):
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        count = np.diff(np.append(first, len(part)))
        best = np.minimum.reduceat(rank, first)
        if (ended := best == NONE).any():
            over = np.repeat(ended, count)
            done.append((sym[over], part[over], place[over]))
            sym, part, place, rank, made = (x[~over] for x in (sym, part, place, rank, made))
            best, count = best[~ended], count[~ended]
            if not len(sym):
                break
        best = np.repeat(best, count)
        hit = np.flatnonzero(rank == best)
        run = np.append(True, np.diff(hit) != 1)
        begun = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
        leftmost = np.append(True, part[hit[1:]] != part[hit[:-1]])
        # leftmost first; of overlapping occurrences each second one
        chosen = hit[np.where(p.one_by_one[np.minimum(best[hit], len(p.one_by_one) - 1)], leftmost, (hit - begun) % 2 == 0)]
        sym[chosen] = made[chosen]
        keep = np.ones(len(sym), bool)
        keep[chosen + 1] = False
        moved = np.cumsum(keep) - 1
        sym, part, place, rank, made = (x[keep] for x in (sym, part, place, rank, made))
        now = moved[chosen]
        changed = np.zeros(len(sym), bool)
        changed[now] = changed[np.maximum(now - 1, 0)] = True
        stale = np.flatnonzero(changed)
        rank[stale], made[stale] = ranked(stale)
    sym, part, place = (np.concatenate([d[k] for d in done]) if done else np.zeros(0, np.int64) for k in range(3))
    order = np.argsort(place)
    sym, part, place = sym[order], part[order], place[order]
    odd = np.flatnonzero((sym < 0) | (sym >= p.size))
    if len(odd):
        raw = [chr(points[k]).encode("utf-8", "surrogatepass") for k in place[odd]]
        ids = [p.bytes[list(x)] if (p.bytes[list(x)] >= 0).all() else np.array([p.unknown]) for x in raw]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(x) for x in ids]
        part, sym = np.repeat(part, times), np.repeat(sym, times)
        ends = np.cumsum(times)
        fill = np.concatenate([np.arange(ends[k] - times[k], ends[k]) for k in odd])
        sym[fill] = np.concatenate(ids)
    return sym.astype(np.int32), np.searchsorted(part, np.arange(len(parts) + 1))


def _gather(flat: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The slices numbered ``wanted``, one after the other."""
    sizes = np.diff(starts)[wanted]
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts[wanted] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def encode(texts: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all texts and where each text's begin; the ids of the empty text are none."""
    cut = [_PARTS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    at = np.append(0, np.cumsum([len(c) for c in cut]))
    number: dict[str, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for c in cut for w in c], np.int64)
    ids, starts = encode_parts(list(number), p)
    ends = np.append(0, np.cumsum(np.diff(starts)[codes]))
    return _gather(ids, starts, codes), ends[at]


def decode(ids: np.ndarray, starts: np.ndarray, p: Pieces) -> list[str]:
    """Texts of the rows of ids: bytes of the pieces, without the space before the text; broken UTF-8 gives U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= p.size):
        raise ValueError("an id lies outside the vocabulary")
    out, shown = [], p.shown
    for a, b in zip(starts[:-1], starts[1:]):
        own = ids[a:b]
        if len(own) and p.silent[own].any():  # characters do not join over a control piece
            pieces_of = np.split(own, np.flatnonzero(p.silent[own]))
            said = "".join(_text(b"".join([shown[i] for i in x.tolist()])) for x in pieces_of).encode("utf-8", "surrogatepass")
        else:
            said = b"".join([shown[i] for i in own.tolist()])
        heard = np.flatnonzero(~p.silent[own]) if len(own) and p.silent[own[0]] else np.zeros(min(1, len(own)), int)
        if len(heard) and p.opens[own[heard[0]]]:
            said = said[1:]
        out.append(_text(said))
    return out


def _text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return _lenient(raw)


def _lenient(raw: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that starts no valid character."""
    out, i = [], 0
    while i < len(raw):
        for k in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + k].decode())
                i += k
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


def round_trip(docs: DataFrame, model: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ids (array of int) of each whole text, and decoded: the text that the ids stand for."""
    chosen = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    schema = docs.select(*keep, F.array(F.lit(0)).alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            for a, b in row_blocks(offsets, BLOCK):
                raw = data[offsets[a] : offsets[b]].tobytes()
                base = offsets[a]
                texts = [raw[x - base : y - base].decode("utf-8", "replace") for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1])]
                ids, starts = encode(texts, p)
                lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), lists, pa.array(decode(ids, starts, p), pa.string())], [*keep, "ids", "decoded"])

    return chosen.mapInArrow(run, schema)
