from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracelake.functions.models import normal_name
from tracelake.operators import pricing
from tracelake.operators.pricing import RateCard
from tracelake.schema import USAGE
from tracelake.sources.traces import load_rate_card


def rates(spark, names, card=None):
    frame = spark.createDataFrame([(n,) for n in names], "model string")
    return {r["model"]: (r["prompt_rate"], r["completion_rate"], r["cached_rate"]) for r in pricing.price_models(frame, card).collect()}


def cost(spark, model, prompt, completion, cached=0, card=None):
    frame = spark.createDataFrame([(model, prompt, completion, cached)], "model string, prompt_tokens long, completion_tokens long, cached_tokens long")
    return pricing.call_cost(frame, card).first()


def test_normal_names(spark):
    cases = {
        "openai/gpt-4o": "gpt-4o",
        "anthropic/claude-3-5-sonnet:latest": "claude-3-5-sonnet",
        "gpt_4o_mini": "gpt-4o-mini",
        "": "unknown",
        None: "unknown",
        " \tA/B/Foo_1:x:y\n": "foo-1",
    }
    frame = spark.createDataFrame([(k,) for k in cases], "m string").selectExpr("m", f"{normal_name('m')} as n")
    assert {r["m"]: r["n"] for r in frame.collect()} == cases


def test_listed_prefix_and_family_rates(spark):
    found = rates(spark, ["gpt-4o", "gpt-4o-2024-99-99", "x-gpt-4o-mini-y", "my-realtime", "realtime-mini", "gpt-5.7", "nope", "unknown", "openai/"])
    D = Decimal
    assert found["gpt-4o"] == (D("2.5"), D("10"), D("1.25"))
    assert found["gpt-4o-2024-99-99"] == (D("2.5"), D("10"), D("1.25"))
    assert found["x-gpt-4o-mini-y"][:2] == (D("0.15"), D("0.6"))
    assert found["my-realtime"][:2] == (D("5"), D("20"))
    assert found["realtime-mini"][:2] == (D("0.6"), D("2.4"))
    assert found["gpt-5.7"] == (D("5"), D("30"), D("0.5"))
    for name in ("nope", "unknown", "openai/"):
        assert found[name] == (None, None, None)


@pytest.mark.parametrize(
    "model,prompt,completion,cached,expected",
    [
        ("gpt-4o", 1000, 500, 0, ("0.0025", "0.005", "0.0075")),
        ("gpt-6-astra", 10000, 1000, 8000, ("0.028", "0.05", "0.078")),
        ("gpt-4o", 100, 0, 500, ("0.000625", "0", "0.000625")),
        ("gpt-4o", -5, 10, 0, ("0", "0.0001", "0.0001")),
    ],
)
def test_cost(spark, model, prompt, completion, cached, expected):
    row = cost(spark, model, prompt, completion, cached)
    assert (row["prompt_cost"], row["completion_cost"], row["total_cost"]) == tuple(map(Decimal, expected))
    assert row["is_estimated"]


def test_unknown_model_costs_nothing(spark):
    row = cost(spark, "some-unknown", 1000, 1000)
    assert row["total_cost"] == 0 and not row["is_estimated"]


def test_own_prices(spark):
    card = RateCard().with_model("My_Model", 1.20, 3.40).with_cached_input("my-model", 0.1)
    row = cost(spark, "acme/my-model", 100_000, 50_000, card=card)
    assert row["total_cost"] == Decimal("0.29")
    # Prefix either way, registration order; a listed exact name beats an own prefix.
    card = RateCard().with_model("gpt-4", 1, 1).with_model("zeta-long-name", 7, 8)
    found = rates(spark, ["gpt-4", "gpt-4o", "gpt-4x", "zeta", "zeta-long-name-2"], card)
    assert found["gpt-4"][:2] == (1, 1)
    assert found["gpt-4o"][:2] == (Decimal("2.5"), 10)
    assert found["gpt-4x"][:2] == (1, 1)
    assert found["zeta"][:2] == (7, 8) and found["zeta-long-name-2"][:2] == (7, 8)


def test_inline_and_joined_cards_agree(spark):
    card = RateCard()
    for i, name in enumerate(["gpt-4", "o1-x", "claude-3", "zed", "gpt-4o", "ze"]):
        card = card.with_model(name, i + 1, i + 2)
    names = ["gpt-4", "gpt-4o-x", "o1", "o1-x-y", "claude-3-opus", "claude-3-9", "zed-9", "z", "unknown", "", "gpt-5", None]
    frame = spark.createDataFrame([(n,) for n in names], "model string")
    rows = pricing.rate_card(spark, card)
    inline = sorted(map(repr, pricing.price_models(frame, card).collect()))
    joined = sorted(map(repr, pricing.price_models(frame, rows).collect()))
    assert inline == joined


def test_strict_cached_input(spark):
    assert rates(spark, ["gpt-4o-mini"])["gpt-4o-mini"][2] == Decimal("1.25")
    assert rates(spark, ["gpt-4o-mini"], RateCard(strict_cached=True))["gpt-4o-mini"][2] is None


def test_load_rate_card(spark, tmp_path):
    card, n = load_rate_card(spark, {"m1": [1.25, 5.0], "m2": {"prompt": 0.5, "completion": 2.0}, "m3": {"input": 3, "output": 4}, "bad": 5, "short": [1]})
    assert n == 3
    assert card.rates == {"m1": (Decimal("1.25"), 5), "m2": (Decimal("0.5"), 2), "m3": (3, 4)}
    path = tmp_path / "prices.json"
    path.write_text('{"m9": {"prompt_per_million": 0, "input": 2, "completion_per_million": 6}}')
    card, n = load_rate_card(spark, str(path))
    assert n == 1 and card.rates["m9"] == (2, 6)


def test_overlay(spark):
    card = pricing.rate_card(spark, RateCard().with_model("gpt-4o", 9, 9))
    merged = pricing.overlay_rate_card(card.filter("source = 'default'"), card.filter("source = 'custom'"))
    row = merged.filter("model = 'gpt-4o'").first()
    assert (row["source"], row["prompt_rate"], row["cached_rate"]) == ("custom", 9, Decimal("1.25"))
    assert merged.count() == merged.select("model").distinct().count()
    assert merged.filter(F.col("prompt_rate").isNull()).count() == 0


def test_fields_that_nobody_reads_are_not_made(spark):
    calls = "array(named_struct('span_type', 'llm', 'name', 'LLM: gpt-4o', 'model', '', 'usage', cast(named_struct('model', null, 'prompt_tokens', 1000L, "
    calls += "'completion_tokens', 0L, 'total_tokens', 0L, 'cached_tokens', 0L, 'prompt_tokens_details', null, 'prompt_cost', null, 'completion_cost', null, 'total_cost', null) as " + USAGE + ")))"
    fields = ["span_type", "name", "model", "usage"]
    whole, _ = pricing.add_fields(calls, fields, pricing.usage_steps())
    some, left = pricing.add_fields(calls, fields, pricing.usage_steps(), ["model", "total_cost"])
    assert sorted(left) == ["model", "total_cost"] and "is_estimated" not in some
    row = spark.range(1).selectExpr(f"({whole})[0] as a", f"({some})[0] as b").first()
    assert (row.b.model, row.b.total_cost) == (row.a.model, row.a.total_cost) == ("gpt-4o", row.a.total_cost)
