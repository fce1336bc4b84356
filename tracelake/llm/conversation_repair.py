"""Conversation structure repair: the cheapest edits that turn a conversation into an optional system turn and user-assistant pairs.

Every path of edits has one integer weight. Its high digits are the cost; below them stand a fixed number of digits, one
for each place of the audit (the edits' initials in order), zeros at the end. A letter's digit grows with its ASCII code, so
the smallest integer is the cheapest path and, among equally cheap ones, the one whose audit comes first. Writing an edit
in front of a suffix moves the suffix down one digit, so an ordinary minimum over a DAG of (row, state, inserts) decides.

A conversation is cut into segments of ``SEGMENT`` rows. For each pair of states the path through a segment is solved on its
own, on any executor, and the segments are joined from the last to the first. That is exact: two paths of equal cost
through the same rows cannot have audits of which one begins with the other, as the rest would be inserts, which cost.
What meets in one row for a conversation is its audit and 12 candidates per segment, some 16 bytes a row. The text of a
repaired conversation is never gathered: its digest runs over sorted rows as a stream.

Defined results: null ids are one conversation; null roles and texts count as one space, as does a null part of the key that
chooses a row's damage. Rows of one turn are ordered by role, then text; null turns come first. Repeated rows are rows.
An empty role has no initial that fits, so such a row is never kept. Very long texts pass through as they are. An empty
table gives no rows; a conversation without rows has empty values. Other columns take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.operators.ranking import row_numbers

#: Rows solved together.
SEGMENT = 512
#: What may be done to a row and with what digit its initial is written, in ASCII order.
LETTERS = "DIKR"
DIGIT = {letter: n + 1 for n, letter in enumerate(LETTERS)}
BITS = 3
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: States: nothing yet, after a system turn, after a user, after an assistant. Accepting: the first and the last.
STATES, STEPS = 4, {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ACCEPTING = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
WHITE = " \t\n\x0b\x0c\r"


def solve(rows: list[tuple[str, str]], ends: tuple[int, ...]) -> dict[int, tuple[int, str, list[str]]]:
    """For each state to start from: (cost, audit, output initials per row) of the best path to one of ``ends``.

    ``rows`` are (initial, fault). The output of row i lists what stands for it, inserts before it first; one more entry at the
    end lists the inserts after the last row.
    """
    n = len(rows)
    width = BITS * (3 * n + 2)
    top = {letter: digit << (width - BITS) for letter, digit in DIGIT.items()}

    def before(weight: int, letter: str, cost: int) -> int:
        """The weight with one more edit in front."""
        price, audit = weight >> width, weight & ((1 << width) - 1)
        return ((price + cost) << width) | top[letter] | (audit >> BITS)

    # reach[i][q]: weight from row i and state q on; choice tells (letter, initial written, next state, whether a row is used)
    after: dict[int, int] = {q: 0 for q in ends}
    chosen: list[dict[int, tuple[str, str, int, bool]]] = []
    for i in range(n, -1, -1):
        best: dict[int, int] = {}
        how: dict[int, tuple[str, str, int, bool]] = {}

        def offer(q: int, weight: int, move: tuple[str, str, int, bool] | None) -> bool:
            if q in best and best[q] <= weight:
                return False
            best[q] = weight
            how.pop(q, None)
            if move:
                how[q] = move
            return True

        if i == n:
            for q, weight in after.items():
                offer(q, weight, None)
        else:
            initial, fault = rows[i]
            short = CUT_SHORT if fault == "truncated" else 0
            for q, weight in after.items():
                offer(q, before(weight, "D", DELETE), ("D", "", q, True))
            if fault in ("none", "truncated"):
                for letter in (initial, "u", "a"):
                    for q, to in STEPS.get(letter, {}).items():
                        if to in after:
                            same = letter == initial
                            offer(q, before(after[to], "K" if same else "R", (KEEP if same else REROLE) + short), ("K" if same else "R", letter, to, True))
        # an insert leads to the same row: at most three follow one another before a state comes again
        for _ in range(3):
            changed = False
            for letter in NAMES:
                for q, to in STEPS[letter].items():
                    if to in best:
                        changed |= offer(q, before(best[to], "I", INSERT), ("I", letter, to, False))
            if not changed:
                break
        chosen.append(how)
        after = best
    chosen.reverse()
    result = {}
    for start, weight in after.items():
        q, audit, out = start, [], []
        for i in range(n + 1):
            said = ""
            while (move := chosen[i].get(q)) is not None:
                letter, written, q, used = move
                audit.append(letter)
                said += written if letter != "I" else written.upper()
                if used:
                    break
            out.append(said)
        result[start] = (weight >> width, "".join(audit), out)
    return result


def join_segments(parts: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str, list[int]]:
    """(cost, audit, state each segment starts in, and the last) of the best path through all segments in order.

    ``parts`` tells of each segment the (cost, audit) of the best path for each (start, end). A digit is a whole byte here.
    """
    width = 8 * sum(max(len(audit) for _, audit in part.values()) for part in parts)
    digits = (1 << width) - 1
    rests = [{q: (0, q) for q in ACCEPTING}]
    for part in reversed(parts):
        best: dict[int, tuple[int, int]] = {}
        for (p, q), (cost, audit) in part.items():
            if q in rests[-1]:
                rest, size = rests[-1][q][0], 8 * len(audit)
                own = int.from_bytes(audit.encode(), "big") << (width - size)
                weight = (((rest >> width) + cost) << width) | own | ((rest & digits) >> size)
                if p not in best or weight < best[p][0]:
                    best[p] = (weight, q)
        rests.append(best)
    rests.reverse()
    states = [0]
    for k in range(len(parts)):
        states.append(rests[k][states[-1]][1])
    weight = rests[0][0][0]
    audit = (weight & digits).to_bytes(width // 8, "big").rstrip(b"\0").decode()
    return weight >> width, audit, states


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a checksum of each row's place chooses."""
    space = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(place) % 20).alias("_d"))
    rows = rows.where("_d <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("_times"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("_times").alias("_copy")).drop("_copy")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their 0-based place in the conversation and their first fault."""
    keyed = rows.withColumns({"conv": F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")), "same": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"), 256)})
    # null turns first; a slice is 256 turns of one conversation, or the null turns that begin alike
    slices = ["coalesce(turn div 256, -9223372036854775808)", "if(turn is null, role, '')", "if(turn is null, substr(text, 1, 4), '')"]
    numbered = row_numbers(keyed, "conv", ["turn nulls first", "role", "text"], slices, "_n")
    placed = stored(numbered.withColumn("pos", F.col("_n").cast("long") - 1).drop("_n"), "placed-turns")
    first = placed.groupBy("conv", "same").agg(F.min("pos").alias("first"))
    said = F.rtrim(F.col("text"), F.lit(WHITE))
    whole = F.substring(said, -1, 1).isin(".", "!", "?")
    fault = F.when(said == "", "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~whole, "truncated").otherwise("none")
    return placed.join(first, ["conv", "same"]).withColumn("fault", fault).drop("same", "first")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best (cost, audit) of each segment for every start and end."""
    for batch in batches:
        convs, segs, initials, faults = (batch.column(k).to_pylist() for k in range(4))
        rows = []
        for conv, seg, own, wrong in zip(convs, segs, initials, faults):
            pairs = list(zip(own, wrong))
            for end in range(STATES):
                for start, (cost, audit, _) in solve(pairs, (end,)).items():
                    rows.append((conv, seg, start, end, cost, audit))
        names = ["conv", "seg", "start", "stop", "cost", "audit"]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost, audit and the segments' first and last states of each conversation."""
    for batch in batches:
        out = []
        for conv, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            parts: list[dict[tuple[int, int], tuple[int, str]]] = [{} for _ in range(1 + max(p["seg"] for p in paths))]
            for p in paths:
                parts[p["seg"]][p["start"], p["stop"]] = (p["cost"], p["audit"])
            cost, audit, states = join_segments(parts)
            out.append((conv, cost, audit, states))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "cost", "audit", "states"])


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands for each row of a segment whose first and last state are known."""
    for batch in batches:
        convs, segs, initials, faults, starts, stops = (batch.column(k).to_pylist() for k in range(6))
        said = [solve(list(zip(own, wrong)), (stop,))[start][2] for own, wrong, start, stop in zip(initials, faults, starts, stops)]
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.string()), pa.array(segs, pa.int64()), pa.array(said, pa.list_(pa.string()))], ["conv", "seg", "said"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the lines of each conversation; rows come sorted by conversation and place."""
    conv, running, lines = None, None, 0

    def told(pairs: list[tuple[str, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["conv", "digest"])

    for batch in batches:
        done = []
        for key, line in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            if key != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running, lines = key, hashlib.sha256(), 0
            if (text := line.as_py()) is not None:
                running.update((b"\n" if lines else b"") + text.encode())
                lines += 1
        if done:
            yield told(done)
    if running is not None:
        yield told([(conv, running.hexdigest())])


def repaired_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, paths): turns has conv, conv_id, pos, turn, role, text, fault and ``line`` of every row: the repaired ``role:text`` lines
    that stand for it (null: none), inserts before it included; paths has conv, cost and audit."""
    placed = stored(_placed(rows), "faulty-turns").withColumn("seg", F.expr(f"pos div {SEGMENT}"))
    one = F.struct("pos", F.substring("role", 1, 1).alias("initial"), "fault")
    segments = placed.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(one)).alias("rows"))  # at most SEGMENT rows
    segments = stored(segments.select("conv", "seg", F.col("rows.initial").alias("initials"), F.col("rows.fault").alias("faults")), "segments")
    best = segments.mapInArrow(_paths, "conv string, seg long, start int, stop int, cost long, audit string")
    gathered = best.groupBy("conv").agg(F.collect_list(F.struct("seg", "start", "stop", "cost", "audit")).alias("paths"))
    paths = stored(gathered.mapInArrow(_joined, "conv string, cost long, audit string, states array<int>"), "paths")
    ways = paths.select(
        "conv", F.explode(F.transform(F.slice("states", F.lit(1), F.size("states") - 1), lambda q, k: F.struct(k.cast("long").alias("seg"), q.alias("start"), F.get("states", k + 1).alias("stop")))).alias("w")
    ).select("conv", "w.seg", "w.start", "w.stop")
    said = segments.join(ways, ["conv", "seg"]).mapInArrow(_outputs, "conv string, seg long, said array<string>")
    each = placed.join(said, ["conv", "seg"])
    k = (F.col("pos") % SEGMENT).cast("int")
    # capitals are inserts; the entry after the last row of a segment holds the inserts behind it
    own, behind = F.get("said", k), F.when(k == F.size("said") - 2, F.get("said", k + 1)).otherwise("")

    def lines(text: Column) -> Column:
        def line(letter: Column) -> Column:
            inserted = F.when(letter == "U", "user:").when(letter == "A", "assistant:")
            kept = F.when(letter == F.substring("role", 1, 1), F.col("role")).when(letter == "u", "user").otherwise("assistant")
            return F.coalesce(inserted, F.concat(kept, F.lit(":"), F.col("text")))

        return F.transform(F.filter(F.split(text, ""), lambda x: x != ""), line)

    every = F.concat(lines(own), lines(behind))
    line = F.when(F.size(every) > 0, F.array_join(every, "\n"))
    return each.withColumn("line", line).drop("said", "seg"), paths.select("conv", "cost", "audit")


def repair(conversations: DataFrame) -> DataFrame:
    """Per conversation of undamaged rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit and the digest of the repaired lines."""
    turns, paths = repaired_turns(conversations)
    turns = stored(turns.drop("text"), "repaired-turns")

    def many(fault: str) -> Column:
        return F.count_if(F.col("fault") == fault).alias(fault)

    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    # a pair of neighbours is told by the later row; a slice of a conversation meets the row before it by its place
    initial = F.substring("role", 1, 1)
    turned = turns.select("conv", (F.col("pos") + 1).alias("pos"), initial.alias("one")).join(turns.select("conv", "pos", initial.alias("two")), ["conv", "pos"])
    illegal = turned.groupBy("conv").agg(F.count_if(~F.concat("one", "two").isin("su", "ua", "au")).alias("illegal"))
    counts = turns.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), span, many("blank"), many("duplicate"), many("truncated"))
    streamed = turns.select("conv", "line", "pos").repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "line")
    digests = streamed.mapInArrow(_digests, "conv string, digest string")
    parts = [counts, paths, digests]
    whole = reduce(lambda x, y: x.join(y, "conv"), parts).join(illegal, "conv", "left")
    return whole.select("conv_id", "gaps", "blank", "duplicate", "truncated", F.coalesce("illegal", F.lit(0)).alias("illegal"), "cost", "audit", F.col("digest").alias("repaired_sha256"))


def damage_and_repair(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, with a row for every conversation of the input."""
    fixed = repair(damaged(conversations)).withColumnRenamed("conv_id", "_id")
    every = conversations.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = {n: F.coalesce(n, F.lit(0)).cast("long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.withColumns({**zero, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))})
