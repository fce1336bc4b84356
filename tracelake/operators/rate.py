"""Requests beyond a client's allowance in a sliding minute.

A request is rejected if ``limit`` accepted ones lie in the minute (t - 60 s, t] before it; rejected
ones do not count. All that matters of a client's requests is how many there are at each instant, so instants are judged, and
requests only look up how many of theirs were accepted.

Counting all requests gives an upper bound: while it stays within the limit nothing is rejected. Only the busy stretches
where it does not are folded in order, each on its own. A stretch ends where no request of the minute before can have been
accepted (there is none) or where all of them have been. The fold steps from one acceptance to the next, however many requests
are turned away in between.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
DEFAULT_PER_MINUTE = 1200


def client_of(forwarded_for: Column, peer: Column) -> Column:
    """First address of the forwarding header, else the peer."""
    return F.coalesce(F.trim(F.element_at(F.split(forwarded_for, ","), 1)), peer, F.lit("unknown"))


def instants_of(requests: DataFrame) -> DataFrame:
    """(client, t, n): requests per client and microsecond."""
    return requests.groupBy("client", F.unix_micros("ts").alias("t")).agg(F.count("*").alias("n"))


def busy_minutes(requests: DataFrame, per_minute: int) -> DataFrame:
    """(client, slot, episode): minutes in which the count of all requests exceeds the limit."""
    return _busy(instants_of(requests), per_minute).select("client", "slot", "episode")


def _busy(instants: DataFrame, per_minute: int) -> DataFrame:
    """(client, slot, episode, clear): busy minutes of a client by stretch; ``clear``: nothing before the stretch counts.

    Each minute of a client is looked at on its own together with the minute before, so a client sending most requests
    spreads over its minutes.
    """
    home = instants.withColumn("slot", F.floor(F.col("t") / MINUTE))
    shown = home.select("client", "t", "n", F.explode(F.array("slot", F.col("slot") + 1)).alias("shown"), "slot")
    minute = Window.partitionBy("client", "shown").orderBy("t").rangeBetween(-(MINUTE - 1), 0)
    counted = shown.withColumn("seen", F.sum("n").over(minute)).filter(F.col("shown") == F.col("slot"))
    slots = counted.groupBy("client", "slot").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("seen").alias("seen"))
    # One row per busy minute of a client from here on.
    line = Window.partitionBy("client").orderBy("slot")
    quiet = F.coalesce(F.col("first") - F.lag("last").over(line) >= MINUTE, F.lit(True))
    parted = F.coalesce(F.col("slot") - F.lag("slot").over(line) > 1, F.lit(True))
    starts = slots.filter(F.col("seen") > per_minute).withColumns({"new": (quiet | parted).cast("int"), "clear": quiet & ~parted})
    return starts.withColumn("episode", F.sum("new").over(line)).select("client", "slot", "episode", "clear", "new")


def _fold(t: np.ndarray, n: np.ndarray, limit: int, held: deque) -> np.ndarray:
    """How many requests are accepted at each of the ascending instants; ``held`` are (instant, accepted) of the minute before,
    and afterwards of the last minute."""
    out, total, i = np.zeros(len(t), np.int64), sum(a for _, a in held), 0
    upto = np.cumsum(n)
    while i < len(t):
        while held and held[0][0] <= t[i] - MINUTE:
            total -= held.popleft()[1]
        # nothing expires before this instant
        until = int(np.searchsorted(t, (held[0][0] if held else t[i]) + MINUTE))
        if total >= limit:
            i = until
            continue
        done = upto[i - 1] if i else 0
        whole = int(np.searchsorted(upto[i:until], done + limit - total, "right"))
        out[i : i + whole] = n[i : i + whole]
        held.extend(zip(t[i : i + whole].tolist(), n[i : i + whole].tolist()))
        total += int(upto[i + whole - 1] - done) if whole else 0
        i += whole
        if i < until and total < limit:
            out[i] = limit - total
            held.append((int(t[i]), limit - total))
            total = limit
            i += 1
    return out


def _folded(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come by client, stretch and time; only accepted instants of the last minute are held.
        stretch, held = None, deque()
        for batch in batches:
            if not len(batch):
                continue
            edge = (batch["client"] != batch["client"].shift()) | (batch["episode"] != batch["episode"].shift())
            first = np.flatnonzero(edge.to_numpy())
            t, n, accepted = batch["t"].to_numpy(), batch["n"].to_numpy(), np.zeros(len(batch), np.int64)
            for a, b in zip(first, [*first[1:], len(batch)]):
                now = (batch["client"].iloc[a], batch["episode"].iloc[a])
                if now != stretch:
                    stretch, held = now, deque()
                accepted[a:b] = _fold(t[a:b], n[a:b], limit, held)
            out = batch[["client", "t", "n", "lead_in"]].assign(accepted=accepted)
            yield out[~out["lead_in"]].drop(columns="lead_in")

    return run


def judged_instants(instants: DataFrame, per_minute: int) -> DataFrame:
    """(client, t, n, accepted) of every instant (client, t, n)."""
    busy = _busy(instants, per_minute)
    timed = instants.select("client", "t", "n", F.floor(F.col("t") / MINUTE).alias("slot"))
    # the minute before a stretch was accepted as a whole, unless it is known not to count
    before = busy.filter((F.col("new") == 1) & ~F.col("clear")).select("client", (F.col("slot") - 1).alias("slot"), "episode")
    roles = busy.select("client", "slot", "episode", F.lit(False).alias("lead_in")).unionByName(before.withColumn("lead_in", F.lit(True)))
    folded = (
        timed.join(roles, ["client", "slot"])
        .repartition("client", "episode")
        .sortWithinPartitions("client", "episode", "t")
        .select("client", "t", "n", "episode", "lead_in")
        .mapInPandas(_folded(per_minute), "client string, t bigint, n bigint, accepted bigint")
    )
    calm = timed.join(busy.select("client", "slot"), ["client", "slot"], "left_anti")
    return calm.select("client", "t", "n", F.col("n").alias("accepted")).unionByName(folded)


def verdicts(requests: DataFrame, judged: DataFrame) -> DataFrame:
    """(request_id, client, ts, rejected) of requests whose instants are judged; of an instant's requests the first ids are accepted."""
    full = judged.filter(F.col("accepted") < F.col("n")).select("client", "t", "accepted")
    timed = requests.select("request_id", "client", "ts", F.unix_micros("ts").alias("t")).join(full, ["client", "t"], "left")
    some = F.coalesce(F.col("accepted") > 0, F.lit(False))
    turn = F.row_number().over(Window.partitionBy("client", "t").orderBy("request_id"))
    plain = timed.filter(~some).select("request_id", "client", "ts", F.col("accepted").isNotNull().alias("rejected"))
    return plain.unionByName(timed.filter(some).select("request_id", "client", "ts", (turn > F.col("accepted")).alias("rejected")))


def rate_violations(requests: DataFrame, per_minute: int = DEFAULT_PER_MINUTE) -> DataFrame:
    """(request_id, client, ts, rejected) for every request; a limit of 0 or less rejects none."""
    if per_minute <= 0:
        return requests.select("request_id", "client", "ts", F.lit(False).alias("rejected"))
    return verdicts(requests, judged_instants(instants_of(requests), per_minute))
