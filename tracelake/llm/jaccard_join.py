"""N-gram Jaccard join: links between texts whose sets of word shingles are similar, and the groups they form.

A set-relation-skipping join. Shingles are ordered by rarity, and a set is indexed under the first ones only, as far as a
similar set must share one (prefix filter). Equal sets are one class. Each index list first checks its sets against one centre;
sets linked to a centre form a block. Then lists skip: those whose sets are already connected; blocks
whose sizes, positions in the list or parity bits leave too little to share; and blocks for which the answer of their centre, off by at most
what the members lack of it, already rules every member out. Only what is left is compared set by set, so no
link between different groups is lost, and links within a group need no proof.

Null texts and texts without words have an empty set and stand alone; with fewer words than ``width`` the whole sequence is
the one shingle. A row with a null id has the component of an equal set that has one, else null, and links nothing. Repeated
rows are one class. Rows that share an id but
not the text count as one document with several sets. Very long texts are taken whole; their set is one row. An empty table
gives no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import common
from tracelake.llm.common import stored

_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a shingle's hash that the counting of frequencies keeps.
COUNTED = 40
#: Words of 64 parity bits kept of a set: each shingle flips one bit, so two sets differ in at least as many shingles as bits.
PARITY = 8
#: Shingles before one in a set's index that tell whether two sets have met in an earlier list.
EARLIER = 8
#: Pairs of blocks for each block of the lists, up to which all are met at once.
OPEN = 4


@dataclass(frozen=True)
class Join:
    """Sets are linked when percent * union <= 100 * intersection.

    ``filter_bits`` and ``hot`` bound what is broadcast about frequencies (2**filter_bits bits and ``hot`` shingles).
    They decide the order of shingles, hence the speed, never the result. ``stars`` is the number of rounds with a centre.
    """

    width: int = 5
    percent: int = 80
    filter_bits: int = 27
    hot: int = 1 << 18
    hot_from: int = 32
    stars: int = 2


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row."""
    for a, b in common.row_blocks(offsets):
        words, at, _ = common.hash_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n = len(words) - width + 1
        rolled = np.zeros(max(0, n), np.uint64)
        for k in range(width if n > 0 else 0):
            rolled = rolled * _STEP + words[k : k + n]
        rolled = common.mix(rolled + np.uint64(width))
        for i in range(b - a):
            x, y = at[i], at[i + 1]
            if y - x >= width:
                yield np.unique(rolled[x : y - width + 1])
            elif y > x:
                one = np.zeros(1, np.uint64)
                for w in words[x:y]:
                    one = one * _STEP + w
                yield common.mix(one + np.uint64(y - x))
            else:
                yield np.zeros(0, np.uint64)


def prefix_size(n: int, percent: int) -> int:
    """How many of a set's first shingles a similar set shares at least one of."""
    return n - -(-percent * n // 100) + 1


def frequencies(docs: DataFrame, how: Join) -> tuple[np.ndarray, np.ndarray]:
    """Of all shingles of all texts: a bit for each place of the hash that holds one of two documents or more, and the
    hashes of the most frequent (both of bounded size).

    Hashes travel packed, those of a range of hash values in one buffer, counted before within each batch.
    """
    ranges = 64
    while ranges < min(8 * docs.rdd.getNumPartitions(), 1 << (how.filter_bits - 6)):
        ranges *= 2
    bits, drop = ranges.bit_length() - 1, np.uint64(64 - COUNTED)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in common.blocks_of(batches, 0, 2 << 20):
            sets = list(shingles(data, offsets, how.width))
            kept, counts = np.unique(np.concatenate(sets) >> drop, return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            cut = np.searchsorted(kept, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(COUNTED - bits))
            small = kept.view(np.uint8).reshape(-1, 8)[:, : COUNTED // 8]
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int64()),
                    pa.array([small[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()),
                    pa.array([counts[cut[r] : cut[r + 1]].astype(np.uint32).tobytes() for r in some], pa.binary()),
                ],
                ["range", "keys", "counts"],
            )

    def count(part: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(part["keys"]), np.uint8).reshape(-1, COUNTED // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, : COUNTED // 8] = raw
        kept, back = np.unique(wide.view(np.uint64).ravel(), return_inverse=True)
        total = np.bincount(back, np.frombuffer(b"".join(part["counts"]), np.uint32)).astype(np.int64)
        shared = np.zeros(1 << (how.filter_bits - bits), bool)
        shared[((kept[total > 1] >> np.uint64(COUNTED - how.filter_bits)) & np.uint64(len(shared) - 1)).astype(np.int64)] = True
        top = np.argsort(-total, kind="stable")[: min(how.hot, int((total > how.hot_from).sum()))]
        return pd.DataFrame({"range": [part["range"].iloc[0]], "shared": [np.packbits(shared).tobytes()], "hot": [kept[top].astype(np.int64)], "n": [total[top]]})

    packed = docs.select(F.col("text").cast("binary")).mapInArrow(gather, "range long, keys binary, counts binary")
    counted = stored(packed.groupBy("range").applyInPandas(count, "range long, shared binary, hot array<long>, n array<long>"), "frequencies")
    bitmap = np.zeros(1 << (how.filter_bits - 3), np.uint8)
    size = len(bitmap) >> bits
    for row in counted.select("range", "shared").toLocalIterator():
        bitmap[row["range"] * size : (row["range"] + 1) * size] = np.frombuffer(row.shared, np.uint8)
    each = counted.select(F.explode(F.arrays_zip("hot", "n")).alias("x")).select("x.hot", "x.n")
    top = each.orderBy(F.desc("n"), "hot").limit(how.hot).select("hot").toPandas()["hot"].to_numpy(np.int64)
    return bitmap, np.sort(top.astype(np.uint64))


def signatures(docs: DataFrame, known: Broadcast, how: Join) -> DataFrame:
    """(doc_id, n, f1, f2, tokens, places, members, parity): size and fingerprint of each set; of its prefix the shingles
    that other documents may hold, with their places in the order; and, if there are such, the whole set and its parity bits.
    ``known`` is what ``frequencies`` gives."""
    schema = "doc_id long, n long, f1 long, f2 long, tokens array<long>, places array<int>, members array<long>, parity array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, hot = known.value
        for batch, data, offsets in common.blocks_of(batches, 1, 1 << 20):
            n, f1, f2, tokens, places, members, parity = [], [], [], [], [], [], []
            for s in shingles(data, offsets, how.width):
                n.append(len(s))
                f1.append(int(np.bitwise_xor.reduce(common.mix(s)).view(np.int64)) if len(s) else 0)
                f2.append(int(np.add.reduce(common.mix(s ^ _STEP)).view(np.int64)) if len(s) else 0)
                cell = (s >> np.uint64(64 - how.filter_bits)).astype(np.int64)
                kind = (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1
                if len(hot) and kind.any():
                    short = s >> np.uint64(64 - COUNTED)
                    kind += hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short
                first = np.argsort(kind, kind="stable")[: prefix_size(len(s), how.percent)] if len(s) else np.zeros(0, np.int64)
                at = np.flatnonzero(kind[first])
                tokens.append(s[first[at]].view(np.int64))
                places.append(at.astype(np.int32))
                members.append(s.view(np.int64) if len(at) else np.zeros(0, np.int64))
                odd = np.bincount((s & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1 if len(at) else np.zeros(0, np.int64)
                parity.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())]
            columns += [pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(members, pa.list_(pa.int64())), pa.array(parity, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "f1", "f2", "tokens", "places", "members", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def _could(n1: Column, n2: Column, shared: Column, how: Join) -> Column:
    """Whether sets of these sizes that share at most ``shared`` can be linked."""
    return (100 + how.percent) * shared >= how.percent * (n1 + n2)


def _sizes(n1: Column, n2: Column, how: Join) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * how.percent


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared): exact intersections of pairs of nodes."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("members").alias("ma"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("members").alias("mb"))
    met = pairs.join(one, "a").join(two, "b")
    return met.select("a", "b", "na", "nb", F.size(F.array_intersect("ma", "mb")).cast("long").alias("shared"))


def _linked(checked: DataFrame, how: Join) -> DataFrame:
    return checked.where(_could(F.col("na"), F.col("nb"), F.col("shared"), how))


def _neighbours(edges: DataFrame) -> DataFrame:
    """(node, component) with the smallest neighbour, or that one's smallest neighbour, for a component: connected nodes may
    get two, which costs comparisons and no link."""
    low = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"))
    above = low.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return low.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("component"))


def _grouped(lists: DataFrame, groups: DataFrame) -> DataFrame:
    """The lists with a group for each node, whose nodes are connected; lists whose nodes are all of one group are skipped."""
    now = lists.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
    spread = now.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    return now.join(spread, "token")


def _star(lists: DataFrame, seed: int) -> DataFrame:
    """Pairs of each list's centre with its other nodes, of other groups and of sizes and places that allow a link."""
    entry = F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), "node", "n", "pos", "grp")
    centre = lists.groupBy("token").agg(F.min(entry).alias("c"))
    return lists.join(centre, "token").where("node <> c.node and grp <> c.grp")


def links(docs: DataFrame, how: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """(sets, components): sets has doc_id, n and node (the smallest id with an equal set) for every row; components (node, component)
    has the smallest node that a chain of similar sets connects each with, for nodes that have any."""
    counted = docs.sparkSession.sparkContext.broadcast(frequencies(docs, how))
    rows = stored(signatures(docs, counted, how), "signatures")
    counted.destroy()
    nodes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"))
    nodes = stored(nodes, "nodes")
    own = rows.where(F.size("tokens") > 0).dropDuplicates(["doc_id", "f1", "f2"])
    own = own.join(nodes.select(F.col("node").alias("doc_id"), "f1", "f2"), ["doc_id", "f1", "f2"])
    sets = stored(own.select(F.col("doc_id").alias("node"), "n", "members", "tokens", "places", "parity"), "sets")
    postings = sets.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("p")).select(F.col("p.tokens").alias("token"), "node", "n", F.col("p.places").alias("pos"))
    several = postings.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    lists = stored(postings.join(several, "token").withColumn("grp", F.col("node")), "lists")
    checked = None
    for seed in range(how.stars):
        met = _star(lists, seed)
        rest = F.least(F.col("n") - F.col("pos"), F.col("c.n") - F.col("c.pos"))
        met = met.where(_sizes(F.col("n"), F.col("c.n"), how) & _could(F.col("n"), F.col("c.n"), rest, how))
        pairs = met.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        found = verified(pairs, sets)
        checked = stored(found if checked is None else found.unionByName(checked), "checked")
        near = _linked(checked, how)
        known = _components(near) if seed == how.stars - 1 else _neighbours(near)
        lists = stored(_grouped(lists.drop("grp"), known), "lists")
    found = _between_blocks(lists, sets, checked, known, how)
    members = rows.select("doc_id", "n", "f1", "f2").join(nodes, ["f1", "f2", "n"], "left").select("doc_id", "n", "node")
    return members, found


def _components(near: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Components by the linked pairs and those of ``known``, which is returned itself if they join nothing new."""
    found = common.components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")), known)
    return known if known is not None and found is known else stored(found, "components")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes are in different components."""
    for name in ("a", "b"):
        own = groups.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
        pairs = pairs.join(own, name, "left").withColumn(f"_{name}", F.coalesce(f"_{name}", name))
    return pairs.where("_a <> _b").drop("_a", "_b")


def _meetings(block: DataFrame, lower: int, upper: int | None, how: Join) -> DataFrame:
    """Pairs of blocks of one list and two groups that neither sizes, positions, parity bits nor an earlier list rule out: those
    of each list whose turns are from ``lower`` and below ``upper`` with all of later turns."""
    x, y = block.alias("x"), block.alias("y")
    if lower:
        x = x.where(F.col("turn") >= lower)
    if upper is not None:
        x = x.where(F.col("turn") < upper)
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.turn") < F.col("y.turn")) & (F.col("x.grp") != F.col("y.grp")))
    if upper is None:
        both = both.where(~F.coalesce(F.arrays_overlap("x.earlier", "y.earlier"), F.lit(False)))
    lo1, lo2 = F.col("x.lo"), F.col("y.lo")
    apart = sum((F.bit_count(F.get("x.parity", F.lit(k)).bitwiseXOR(F.get("y.parity", F.lit(k)))) for k in range(PARITY)), F.lit(0))
    # twice the most that the centres share, and with what their members have beside them
    most = F.col("x.nc") + F.col("y.nc") - apart + 2 * (F.col("x.off") + F.col("y.off"))
    both = both.where((F.col("x.hi") * 100 >= lo2 * how.percent) & (F.col("y.hi") * 100 >= lo1 * how.percent) & _could(lo1, lo2, F.least("x.rest", "y.rest"), how) & _could(2 * lo1, 2 * lo2, most, how))
    first = F.col("x.c") < F.col("y.c")

    def ordered(name: str, one: str, two: str) -> list[Column]:
        u, v = F.col(f"x.{name}"), F.col(f"y.{name}")
        return [F.when(first, u).otherwise(v).alias(one), F.when(first, v).otherwise(u).alias(two)]

    sides = [*ordered("c", "a", "b"), *ordered("lo", "l1", "l2"), *ordered("off", "off1", "off2")]
    return both.select(F.col("x.token").alias("token"), *sides, (F.col("x.wide") | F.col("y.wide")).alias("wide"))


def _merged(block: DataFrame, sets: DataFrame, checked: DataFrame, known: DataFrame, how: Join) -> tuple[list[tuple[DataFrame, int]], DataFrame, DataFrame, DataFrame]:
    """The rounds' meetings with the turn each ends before, the blocks with the groups they have afterwards, all pairs checked, components.

    While lists hold many pairs of groups, sixteen blocks a list, then four times as many, meet all the others before the
    rest does, and groups whose centres are linked become one. So copies that no centre links, but others do, need a few
    comparisons each instead of one with every other copy.
    """
    turn = Window.partitionBy("token").orderBy(F.xxhash64("token", "c"), "c")
    block = stored(block.withColumn("turn", F.row_number().over(turn) - 1), "block-lists")
    met: list[tuple[DataFrame, int]] = []
    lower, width = 0, 16
    while True:
        held = block.groupBy("token", "grp").agg(F.count("*").alias("k"), F.max("turn").alias("turn"))
        held = held.groupBy("token").agg(F.sum("k").alias("k"), F.sum(F.expr("double(k) * k")).alias("same"), F.max("turn").alias("turn"))
        entries, pairs, last = held.agg(F.sum("k"), F.sum(F.expr("(double(k) * k - same) / 2")), F.max("turn")).first()
        if not entries or last < lower + width or pairs <= OPEN * entries:
            return met, block, checked, known
        now = stored(_meetings(block, lower, lower + width, how), "block-pairs")
        met.append((now, lower + width))
        new = now.select("a", "b").distinct().join(checked, ["a", "b"], "left_anti")
        found = stored(verified(new, sets), "answers")
        checked = checked.unionByName(found)
        groups = _components(_linked(found, how), known)
        if groups is not known:
            known = groups
            joined = block.join(known.withColumnRenamed("node", "c"), "c", "left")
            block = stored(joined.withColumn("grp", F.coalesce("component", "grp")).drop("component"), "block-lists")
        # the rest at once, if it is few even should it go on like this round
        few = now.count() * (last + 1 - lower - width) <= OPEN * entries * width
        lower, width = lower + width, 4 * width
        if few:
            return met, block, checked, known


def _between_blocks(lists: DataFrame, sets: DataFrame, checked: DataFrame, known: DataFrame, how: Join) -> DataFrame:
    """Components by all links, those between the groups that neither block nor centre rules out included. ``known`` has those by
    the pairs checked.

    Centres answer first, and blocks that an answer joins need no more. The rest are opened in rounds: members of one block
    meet sixteen members of the other a list, then four times as many, and what a round joins is left out of the next.
    """
    near = _linked(checked, how)
    near = near.select(F.col("a").alias("node"), F.col("b").alias("c"), "shared").union(near.select("b", "a", "shared"))
    # every node of a pair may be the other's centre: the smaller id is, so a centre is its own block
    near = near.where("c < node").groupBy("node").agg(F.max(F.struct("shared", F.expr("-c").alias("c"))).alias("m"))
    centres = near.join(near.select(F.col("node").alias("x")), F.expr("-m.c") == F.col("x"), "left_anti").select("node", F.expr("-m.c").alias("c"), F.col("m.shared").alias("shared"))
    put = lists.join(centres, "node", "left").select("token", "node", "n", "pos", "grp", F.coalesce("c", "node").alias("c"), (F.col("n") - F.coalesce("shared", "n")).alias("off"))
    put = stored(put, "blocks")
    # two single sets that share an earlier list have met there already
    before = Window.partitionBy("node").orderBy("pos").rowsBetween(-EARLIER, -1)
    block = put.withColumn("earlier", F.collect_list("token").over(before)).groupBy("token", "c", "grp").agg(
        F.min("n").alias("lo"),
        F.max("n").alias("hi"),
        F.max("off").alias("off"),
        F.max(F.col("node") != F.col("c")).alias("wide"),
        F.max(F.col("n") - F.col("pos")).alias("rest"),
        F.when(F.count("*") == 1, F.max("earlier")).alias("earlier"),
    )
    centre = sets.select(F.col("node").alias("c"), F.col("n").alias("nc"), "parity")
    block = block.join(centre, "c")
    met, block, checked, known = _merged(block, sets, checked, known, how)
    lower = met[-1][1] if met else 0
    met = reduce(DataFrame.unionByName, [one for one, _ in met] + [stored(_meetings(block, lower, None, how), "block-pairs")])
    both = met.groupBy("a", "b").agg(F.min("l1").alias("l1"), F.min("l2").alias("l2"), (F.max("off1") + F.max("off2")).alias("off"), F.max("wide").alias("wide"))
    fresh = stored(verified(both.select("a", "b").join(checked, ["a", "b"], "left_anti"), sets), "answers")
    answers = fresh.unionByName(checked.join(both.select("a", "b"), ["a", "b"], "left_semi"))
    # a member that lacks nothing of its centre, a shorter copy, may still be linked where its centre is not
    opened = both.where("wide").join(answers, ["a", "b"]).where(_could(F.col("l1"), F.col("l2"), F.col("shared") + F.col("off"), how)).select("a", "b", "shared")
    opened = stored(opened, "opened")
    checked = checked.unionByName(fresh)
    groups = _components(_linked(fresh, how), known)
    opened = stored(_apart(opened, groups), "opened")
    if opened.isEmpty():
        return groups
    # only in the lists where the blocks passed: the first one that two linked sets share is among them
    places = met.where("wide").select("token", "a", "b")
    needed = places.join(opened, ["a", "b"])
    some = put.join(needed.select("token", F.col("b").alias("c")).distinct(), ["token", "c"], "left_semi")
    turn = Window.partitionBy("token", "c").orderBy(F.xxhash64("node"), "node")
    some = stored(some.withColumn("turn", F.row_number().over(turn) - 1), "opened-members")
    last, lower, width, joined = some.agg(F.max("turn")).first()[0], 0, 16, False
    while last is not None and lower <= last:
        if joined:
            opened = stored(_apart(opened, groups), "opened")
            if opened.isEmpty():
                break
            needed = places.join(opened, ["a", "b"])
        u, v, o = put.alias("u"), some.where((F.col("turn") >= lower) & (F.col("turn") < lower + width)).alias("v"), needed.alias("o")
        pairs = u.join(o, (F.col("u.token") == F.col("o.token")) & (F.col("u.c") == F.col("o.a")))
        pairs = pairs.join(v, (F.col("u.token") == F.col("v.token")) & (F.col("v.c") == F.col("o.b")) & (F.col("u.grp") != F.col("v.grp")))
        rest = F.least(F.col("u.n") - F.col("u.pos"), F.col("v.n") - F.col("v.pos"))
        pairs = pairs.where(_sizes(F.col("u.n"), F.col("v.n"), how) & _could(F.col("u.n"), F.col("v.n"), rest, how))
        pairs = pairs.where(_could(F.col("u.n"), F.col("v.n"), F.col("o.shared") + F.col("u.off") + F.col("v.off"), how))
        pairs = pairs.select(F.least("u.node", "v.node").alias("a"), F.greatest("u.node", "v.node").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
        found = stored(verified(pairs, sets), "opened-pairs")
        checked = checked.unionByName(found)
        lower, width = lower + width, 4 * width
        now = _components(_linked(found, how), groups)
        groups, joined = now, now is not groups
    return groups


def groups(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    members, found = links(docs, how)
    joined = members.join(found, "node", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))


def first_of_each_group(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """The rows whose id is the smallest of their group, all columns kept; of rows that repeat id and text, one. Different texts
    under such an id all stay, and so do null ids."""
    kept = groups(docs, how).where("doc_id = component_id").select("doc_id").distinct().withColumnRenamed("doc_id", "__first")
    first = docs.join(kept, F.col("doc_id") == F.col("__first"), "left_semi")
    once = first.withColumn("__text", F.sha2(F.col("text").cast("binary"), 256)).dropDuplicates(["doc_id", "__text"]).drop("__text")
    return once.unionByName(docs.where("doc_id is null"))
