"""Rates for model names and the cost of calls.

The standard price list has a fixed, small size, so a rate is looked up by expressions inside the
row: no join, no shuffle, and it works on exploded spans and inside nested arrays alike. Prices of
one's own ride along the same way while there are few of them; a long list goes through equi-joins
on the distinct model names instead.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.models import normal_name, span_model
from tracelake.functions.rates import CACHED_RATES, FAMILIES, MODEL_RATES
from tracelake.functions.text import trimmed

RATE = "decimal(12,6)"
TOKENS = "decimal(12,0)"
COST = "decimal(18,6)"
SALTS = 64

CARD_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType(), False),
        T.StructField("seq", T.IntegerType(), False),
        T.StructField("model", T.StringType(), False),
        T.StructField("prompt_rate", T.DecimalType(12, 6)),
        T.StructField("completion_rate", T.DecimalType(12, 6)),
        T.StructField("cached_rate", T.DecimalType(12, 6)),
    ]
)


def _plain_name(name: str) -> str:
    if not name:
        return "unknown"
    return name.strip().lower().rpartition("/")[2].partition(":")[0].replace("_", "-")


@dataclass(frozen=True)
class RateCard:
    """Own prices on top of the standard list; keys are normal names in registration order."""

    rates: dict[str, tuple[Decimal, Decimal]] = field(default_factory=dict)
    cached: dict[str, Decimal] = field(default_factory=dict)
    strict_cached: bool = False

    def with_model(self, model: str, prompt: object, completion: object) -> RateCard:
        entry = (Decimal(str(prompt)), Decimal(str(completion)))
        return RateCard({**self.rates, _plain_name(model): entry}, self.cached, self.strict_cached)

    def with_cached_input(self, model: str, rate: object) -> RateCard:
        cached = {**self.cached, _plain_name(model): Decimal(str(rate))}
        return RateCard(self.rates, cached, self.strict_cached)


def rate_card(spark: SparkSession, own: RateCard | None = None) -> DataFrame:
    """The standard list and one's own prices as rows; ``overlay_rate_card`` merges them."""
    own = own or RateCard()
    listed = [
        ("default", i, model, Decimal(p), Decimal(c), Decimal(CACHED_RATES[model]) if model in CACHED_RATES else None)
        for i, (model, (p, c)) in enumerate(MODEL_RATES.items())
    ]
    mine = [
        ("custom", i, model, *own.rates.get(model, (None, None)), own.cached.get(model))
        for i, model in enumerate(dict.fromkeys([*own.rates, *own.cached]))
    ]
    return spark.createDataFrame(listed + mine, CARD_SCHEMA)


def overlay_rate_card(defaults: DataFrame, custom: DataFrame) -> DataFrame:
    """One row per model; a custom price replaces the default one, field by field."""
    both = defaults.unionByName(custom)
    first = F.when(F.col("source") == "custom", 0).otherwise(1)

    def pick(name: str) -> Column:
        return F.min_by(
            F.when(F.col(name).isNotNull(), F.struct("source", name)),
            F.when(F.col(name).isNotNull(), first),
        )

    chosen = both.groupBy("model").agg(
        pick("prompt_rate").alias("p"), pick("completion_rate").alias("c"), pick("cached_rate").alias("k")
    )
    return chosen.select(
        "model",
        F.col("p.source").alias("source"),
        F.col("p.prompt_rate").alias("prompt_rate"),
        F.col("c.completion_rate").alias("completion_rate"),
        F.col("k.cached_rate").alias("cached_rate"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _longest_prefix(name: str, keys: Iterable[str]) -> str:
    ordered = sorted(keys, key=len, reverse=True)
    pattern = "^(" + "|".join(re.escape(key).replace(r"\-", "-") for key in ordered) + ")"
    return f"try_element_at(regexp_extract_all({name}, {_text(pattern)}, 1), 1)"


def _rate(value: object) -> str:
    return f"cast('{value}' as {RATE})"


def _rate_map(rates: Mapping[str, tuple[object, object]]) -> str:
    pairs = [
        f"{_text(key)}, named_struct('prompt_rate', {_rate(p)}, 'completion_rate', {_rate(c)})"
        for key, (p, c) in rates.items()
    ]
    return f"map({', '.join(pairs)})"


def _money_map(rates: Mapping[str, object]) -> str:
    return "map(" + ", ".join(f"{_text(key)}, {_rate(rate)}" for key, rate in rates.items()) + ")"


def _family(name: str) -> str:
    rows = [f"struct(array({', '.join(map(_text, words))}) as words, {_text(model)} as model)" for words, model in FAMILIES]
    hits = f"filter(array({', '.join(rows)}), fam -> forall(fam.words, word -> contains({name}, word)))"
    return f"try_element_at({hits}, 1).model"


def _own_prefix(name: str, own: RateCard) -> str:
    keys = ", ".join(map(_text, own.rates))
    return f"try_element_at(filter(array({keys}), own -> startswith({name}, own) or startswith(own, {name})), 1)"


# A computation is a list of steps; each maps names to SQL over the names before it, which it gets
# through ``get``. Run as columns of a frame or as fields of array items, every step is evaluated
# once and then only read.
Step = Callable[[Callable[[str], str]], dict[str, str]]


def add_columns(df: DataFrame, steps: list[Step]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step(lambda n: n).items()})
    return df


def add_fields(items: str, fields: list[str], steps: list[Step], wanted: list[str] | None = None) -> tuple[str, list[str]]:
    """``add_columns`` for the structs of an array with the given fields: (SQL, fields it has then).

    With ``wanted`` only those fields come out, and each step makes and carries only what they need.
    """
    made = [step(lambda n: f"item.{n}") for step in steps]
    needed = None if wanted is None else set(wanted)
    needs = []
    for new in reversed(made):
        needs.insert(0, needed)
        if needed is not None:
            read = {n for name, sql in new.items() if name in needed for n in re.findall(r"\bitem\.(\w+)", sql)}
            needed = (needed - set(new)) | read
    for new, needed in zip(made, needs):
        new = {n: sql for n, sql in new.items() if needed is None or n in needed}
        kept = [f for f in fields if f not in new and (needed is None or f in needed)]
        members = [f"'{f}', item.{f}" for f in kept] + [f"'{n}', {sql}" for n, sql in new.items()]
        if new:
            items, fields = f"transform({items}, item -> named_struct({', '.join(members)}))", [*kept, *new]
    return items, fields


def rate_steps(own: RateCard | None = None) -> list[Step]:
    """From ``model`` to ``prompt_rate``, ``completion_rate`` and ``cached_rate``; null if unknown.

    In order: own price of that very name, listed price of that name, first own name that is a
    prefix of it or the reverse, longest listed prefix, family. Cached input: own, then listed by
    the longest prefix.
    """
    own = own or RateCard()

    def normal(get):
        return {"_normal": normal_name(get("model"))}

    def trim(get):
        return {"_trimmed": trimmed(get("_normal"))}

    def name(get):
        return {"_name": f"if({get('_trimmed')} in ('unknown', ''), null, {get('_trimmed')})"}

    def keys(get):
        found = {"_prefix": _longest_prefix(get("_name"), MODEL_RATES), "_cached": _longest_prefix(get("_name"), CACHED_RATES)}
        if own.rates:
            found["_similar"] = _own_prefix(get("_name"), own)
        return found

    def listed(get):
        return {"_listed": f"if({get('_prefix')} is null and {get('_name')} is not null, {_family(get('_name'))}, {get('_prefix')})"}

    def pair(get):
        found = f"try_element_at({_rate_map(MODEL_RATES)}, {get('_listed')})"
        if own.rates:
            mine = _rate_map(own.rates)
            other = f"if({get('_prefix')} <=> {get('_name')}, null, try_element_at({mine}, {get('_similar')}))"
            found = f"coalesce(try_element_at({mine}, {get('_name')}), {other}, {found})"
        cached_key = f"if({get('_cached')} = {get('_name')}, {get('_cached')}, null)" if own.strict_cached else get("_cached")
        cached = f"try_element_at({_money_map(CACHED_RATES)}, {cached_key})"
        if own.cached:
            cached = f"coalesce(try_element_at({_money_map(own.cached)}, {get('_name')}), {cached})"
        return {"_pair": found, "cached_rate": cached}

    def rates(get):
        return {n: f"{get('_pair')}.{n}" for n in ("prompt_rate", "completion_rate")}

    return [normal, trim, name, keys, listed, pair, rates]


RATE_FIELDS = ["prompt_rate", "completion_rate", "cached_rate"]


def call_cost_steps() -> list[Step]:
    """Cost of a call from its rates and token counts; negative and missing counts are 0."""

    def counts(get):
        named = {"_asked": "prompt_tokens", "_answered": "completion_tokens", "_reused": "cached_tokens"}
        return {n: f"cast(greatest(coalesce({get(count)}, 0), 0) as {TOKENS})" for n, count in named.items()}

    def raw(get):
        fresh = f"cast(greatest({get('_asked')} - {get('_reused')}, 0) as {TOKENS})"
        reduced = f"{fresh} * {get('prompt_rate')} + {get('_reused')} * {get('cached_rate')}"
        discounted = f"{get('_reused')} > 0 and {get('cached_rate')} is not null"
        full = f"{get('_asked')} * {get('prompt_rate')}"
        return {
            "_in": f"(case when {discounted} then {reduced} else {full} end) * 0.000001",
            "_out": f"{get('_answered')} * {get('completion_rate')} * 0.000001",
        }

    def money(get):
        def amount(sql: str) -> str:
            return f"coalesce(cast(round({sql}, 6) as {COST}), cast(0 as {COST}))"

        return {
            "prompt_cost": amount(get("_in")),
            "completion_cost": amount(get("_out")),
            "total_cost": amount(f"{get('_in')} + {get('_out')}"),
            "is_estimated": f"{get('prompt_rate')} is not null",
        }

    return [counts, raw, money]


def call_cost(calls: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Adds prompt, completion and total cost to rows of model, prompt, completion, cached tokens."""
    priced = add_columns(calls, rate_steps(own) + call_cost_steps())
    return priced.select(*calls.columns, "prompt_cost", "completion_cost", "total_cost", "is_estimated")


CALL_FIELDS = [
    "model", "prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens",
    "prompt_cost", "completion_cost", "total_cost", "is_estimated",
]


def usage_steps(own: RateCard | None = None) -> list[Step]:
    """What one model call used and cost, from ``usage``, ``model`` (in metadata) and ``name``.

    Stored costs are trusted; otherwise the call is priced when it has tokens. The model is the
    normal name for calls priced here and the recorded one for the rest.
    """

    def recorded(get):
        usage = get("usage")
        model = span_model(f"{usage}.model", get("model"), get("name"))
        cached = f"coalesce(nullif({usage}.cached_tokens, 0L), {usage}.prompt_tokens_details.cached_tokens, 0L)"
        return {
            "_usage_model": f"{usage}.model",
            "model": f"if({get('span_type')} = 'llm', {model}, null)",
            "prompt_tokens": f"coalesce({usage}.prompt_tokens, 0L)",
            "completion_tokens": f"coalesce({usage}.completion_tokens, 0L)",
            "_given": f"coalesce({usage}.total_tokens, 0L)",
            "cached_tokens": cached,
            "_stored": f"{usage}.total_cost is not null",
            "_stored_prompt": f"{usage}.prompt_cost",
            "_stored_completion": f"{usage}.completion_cost",
            "_stored_total": f"{usage}.total_cost",
        }

    def totals(get):
        prompt, completion = get("prompt_tokens"), get("completion_tokens")
        derive = f"{get('_given')} = 0 and ({prompt} > 0 or {completion} > 0)"
        return {"total_tokens": f"if({derive}, {prompt} + {completion}, {get('_given')})"}

    def outcome(get):
        priced = f"(not {get('_stored')} and {get('total_tokens')} > 0)"
        free = f"cast(0 as {COST})"

        def money(stored: str, computed: str) -> str:
            kept = f"coalesce(cast({get(stored)} as {COST}), {free})"
            return f"case when {get('_stored')} then {kept} when {priced} then {get(computed)} else {free} end"

        return {
            "prompt_cost": money("_stored_prompt", "prompt_cost"),
            "completion_cost": money("_stored_completion", "completion_cost"),
            "total_cost": money("_stored_total", "total_cost"),
            "is_estimated": f"{get('_stored')} or ({priced} and {get('is_estimated')})",
            "model": f"if({priced}, {get('_normal')}, coalesce({get('_usage_model')}, {get('model')}))",
        }

    return [recorded, totals, *rate_steps(own), *call_cost_steps(), outcome]


def usage_of(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Spans with a ``call`` struct of model, tokens and costs; meaningful for model calls."""
    priced = add_columns(spans.withColumn("_model", F.col("model")), usage_steps(own))
    kept = ["_model as model" if c == "model" else c for c in spans.columns]
    return priced.selectExpr(*kept, f"struct({', '.join(CALL_FIELDS)}) as call")


def price_spans(spans: DataFrame, own: RateCard | None = None) -> DataFrame:
    """Model-call spans with a ``call`` struct of model, tokens and costs."""
    return usage_of(spans.filter(F.col("span_type") == "llm"), own)


def price_models(models: DataFrame, card: DataFrame | RateCard | None = None) -> DataFrame:
    """(model) -> model, prompt_rate, completion_rate, cached_rate, one row per distinct name."""
    distinct = models.select("model").distinct()
    if card is None or isinstance(card, RateCard):
        return add_columns(distinct, rate_steps(card)).select("model", *RATE_FIELDS)
    return _price_by_joins(distinct, card)


def _price_by_joins(models: DataFrame, card: DataFrame) -> DataFrame:
    """``rate_steps`` for a price list of any length: every test is an equi-join on a string."""
    named = add_columns(models, rate_steps())
    names = named.select("_name").filter("_name is not null").distinct()
    own = card.filter("source = 'custom'")
    priced = own.filter("prompt_rate is not null").selectExpr("model as _key", "struct(seq, prompt_rate, completion_rate) as hit")

    def prefixes(text: str, alias: str) -> str:
        return f"explode(transform(sequence(1, length({text})), n -> left({text}, n))) as {alias}"

    shorter = names.selectExpr("_name", prefixes("_name", "_key")).join(priced, "_key").select("_name", "hit")
    longer = priced.selectExpr("hit", prefixes("_key", "_name")).join(names, "_name").select("_name", "hit")
    similar = shorter.unionByName(longer).groupBy("_name").agg(F.min("hit").alias("similar"))
    exact = own.selectExpr(
        "model as _name",
        "if(prompt_rate is null, null, struct(seq, prompt_rate, completion_rate)) as exact",
        "cached_rate as own_cached",
    )
    joined = named.join(exact, "_name", "left").join(similar, "_name", "left")

    def choose(rate: str) -> str:
        near = f"if(_prefix <=> _name, null, similar.{rate})"
        return f"if(_name is null, null, coalesce(exact.{rate}, {near}, {rate})) as {rate}"

    cached = "if(_name is null, null, coalesce(own_cached, cached_rate)) as cached_rate"
    return joined.selectExpr("model", choose("prompt_rate"), choose("completion_rate"), cached)
