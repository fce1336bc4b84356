"""Benchmark decontamination by a distributed positional inverted index, with DataFrame functions alone.

The index holds (doc_id, twin, term, pos, around): a posting of a training token, with the words next to it, so that
the lists of the neighbouring terms are met at their offsets without being moved. It is built for the terms asked
for. A phrase is looked up by its rarest term in the corpus; offset by offset the other words then have to agree.

Null and empty texts have no words and no hits; items without words are never found. Texts of any length are one
row. Documents are told apart by id and text hash (``twin``), so repeated rows each get the same result and a null id is
allowed. An item that occurs twice in the benchmark counts once for each of its ids. Without items nothing is hit, and without
documents there are no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower, stored

#: Words are runs of other characters; capitals A-Z are word characters, as they are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bits of a term filter, which has this size whatever it is built from.
FILTER_BITS = 1 << 20


def words(text: Column) -> Column:
    # lower() is the quick way where it can only change A-Z
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), GAP), "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _place(keys: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def bit_filter(keys: DataFrame, *columns: str) -> Column:
    """All keys as one array of FILTER_BITS bits: what is not in it is not a key. A single value of a fixed size."""
    at = keys.select(_place([F.col(c) for c in columns]).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    cells = cells.union(keys.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("cell"), F.lit(0).cast("long").alias("bits")))
    cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", "bits"))), lambda c: c["bits"]).alias("bits")).scalar()


def may_hold(bits: Column, *key: Column) -> Column:
    at = _place(key)
    return F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("twin"), words(F.col("text")).alias("words"))


def corpus_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): occurrences in all documents of the terms asked for, 0 included."""
    bits = bit_filter(terms, "term")
    every = docs.select(F.explode(words(F.col("text"))).alias("term")).where(may_hold(bits, F.col("term")))
    seen = every.groupBy("term").agg(F.count("*").alias("n"))
    return terms.select("term").distinct().join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def _at(array: Column, k: Column) -> Column:
    return F.coalesce(F.get(array, k), F.lit(""))


def build_index(docs: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """Postings of the anchors' terms in all documents, with ``reach`` words on either side.

    A posting is left out where neither neighbour is one that the term has in some phrase: no phrase can stand there.
    """
    left, right = F.get("left", F.size("left") - 1).alias("a"), F.get("right", F.lit(0)).alias("b")
    sides = anchors.where(F.size("left") > 0).select(left, F.col("term").alias("b"), F.lit(0).alias("side"))
    sides = sides.union(anchors.where(F.size("right") > 0).select("term", right, F.lit(1)))
    sides = sides.union(anchors.where((F.size("left") == 0) & (F.size("right") == 0)).select("term", F.lit(""), F.lit(2)))
    terms, sides_bits = bit_filter(anchors, "term"), bit_filter(sides, "a", "b", "side")
    every = _keyed(docs).select("doc_id", "twin", "words", F.posexplode("words").alias("pos", "term")).where(may_hold(terms, F.col("term")))
    pos, term = F.col("pos"), F.col("term")
    near = (
        may_hold(sides_bits, _at(F.col("words"), pos - 1), term, F.lit(0))
        | may_hold(sides_bits, term, _at(F.col("words"), pos + 1), F.lit(1))
        | may_hold(sides_bits, term, F.lit(""), F.lit(2))
    )
    first = F.greatest(pos - reach, F.lit(0))
    return every.where(near).select(
        "doc_id",
        "twin",
        "term",
        "pos",
        F.slice("words", first + 1, pos - first).alias("before"),
        F.slice("words", pos + 2, F.lit(reach)).alias("after"),
    )


def phrase_windows(items: DataFrame, length: int) -> DataFrame:
    """(item_id, words, start, len) of every window of ``length`` words; a shorter item is one window."""
    cut = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    last = F.greatest(F.size("words") - length, F.lit(0))
    return cut.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("start"), F.least(F.size("words"), F.lit(length)).alias("len"))


def anchors_of(docs: DataFrame, windows: DataFrame, reach: int) -> DataFrame:
    """Where each window is looked up: at its rarest term in the corpus. Neighbouring windows mostly share one."""
    each = windows.select("item_id", "words", "start", "len", F.posexplode(F.slice("words", F.col("start") + 1, F.col("len"))).alias("off", "term"))
    counts = corpus_counts(docs, each.select("term"))
    rare = each.join(counts, "term").groupBy("item_id", "words", "start", "len").agg(F.min(F.struct("n", "term", "off")).alias("r"))
    at = rare.select("item_id", "words", "len", (F.col("start") + F.col("r.off")).alias("at"), F.col("r.term").alias("term")).distinct()
    first = F.greatest(F.col("at") - reach, F.lit(0))
    return at.select("item_id", "term", "len", F.slice("words", first + 1, F.col("at") - first).alias("left"), F.slice("words", F.col("at") + 2, F.lit(reach)).alias("right"))


def _agree(one: Column, other: Column, reach: int) -> Column:
    """How many leading words two arrays share, up to ``reach``."""
    out = F.lit(0)
    for k in range(reach - 1, -1, -1):
        same = F.get(one, F.lit(k)).eqNullSafe(F.get(other, F.lit(k))) & F.get(one, F.lit(k)).isNotNull()
        out = F.when(same, out + 1).otherwise(F.lit(0))
    return out


def phrase_matches(index: DataFrame, anchors: DataFrame, reach: int) -> DataFrame:
    """(doc_id, twin, item_id, first, last): runs of words that some windows of an item cover, anchor by anchor."""
    met = index.join(anchors, "term")
    met = met.select("doc_id", "twin", "item_id", "pos", "len", _agree(F.reverse("before"), F.reverse("left"), reach).alias("l"), _agree(F.col("after"), F.col("right"), reach).alias("r"))
    return met.where("l + r + 1 >= len").select("doc_id", "twin", "item_id", (F.col("pos") - F.col("l")).alias("first"), (F.col("pos") + F.col("r")).alias("last"))


def proximity_matches(docs: DataFrame, terms: Sequence[str], span: int) -> DataFrame:
    """(doc_id, twin, first, last): places where all the terms, in any order, stand within ``span`` words.

    Each place starts at one of the terms and ends at the last of the nearest following ones.
    """
    wanted = sorted(set(terms))
    asked = docs.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    postings = _keyed(docs).select("doc_id", "twin", F.posexplode("words").alias("pos", "term")).join(F.broadcast(asked), "term")
    # a posting's neighbours lie in its own slice of the document or in the next one
    cell = F.floor(F.col("pos") / span)
    starts = postings.select("doc_id", "twin", F.col("pos").alias("first"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    ends = postings.select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), F.col("pos").alias("p"), "term", cell.alias("c"))
    near = starts.join(ends, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")) & (F.col("cell") == F.col("c")) & F.col("p").between(F.col("first"), F.col("first") + span - 1))
    reached = near.groupBy("doc_id", "twin", "first", "term").agg(F.min("p").alias("p"))
    return reached.groupBy("doc_id", "twin", "first").agg(F.count("*").alias("n"), F.max("p").alias("last")).where(F.col("n") == len(wanted)).select("doc_id", "twin", "first", "last")


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """(doc_id, twin, n_hit, n_items, items): for documents that hold a window of some item."""
    anchors = stored(anchors_of(docs, phrase_windows(items, length), length - 1), "anchors")
    runs = stored(phrase_matches(build_index(docs, anchors, length - 1), anchors, length - 1).distinct(), "runs")
    spans = runs.groupBy("doc_id", "twin", "first").agg(F.max("last").alias("last"))
    before = F.max("last").over(Window.partitionBy("doc_id", "twin").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, F.coalesce(before, F.lit(-1))), F.lit(0))
    hit = spans.select("doc_id", "twin", fresh.alias("fresh")).groupBy("doc_id", "twin").agg(F.sum("fresh").cast("long").alias("n_hit"))
    found = runs.groupBy("doc_id", "twin").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")).select(F.col("doc_id").alias("d"), F.col("twin").alias("t"), "items")
    both = hit.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")))
    return both.select("doc_id", "twin", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def report(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items (ids as text, sorted) and contaminated."""
    hits = contamination(docs, items, length).withColumnsRenamed({"doc_id": "d", "twin": "t"})
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("twin"), count_words(F.col("text")).alias("n_words"))
    joined = all_docs.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("twin") == F.col("t")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The rows without any hit, with all their columns."""
    bad = contamination(docs, items, length).select(F.col("doc_id").alias("__d"), F.col("twin").alias("__t"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
