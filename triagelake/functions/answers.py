"""Statistics of answers. Probabilities are arrays of (key, p), so that ties keep the options' order."""

from __future__ import annotations

from pyspark.sql import Column

from . import lazy as F

from .text import label_of, pct

#: Pairs of email types that lead to the same lane.
SAME_LANE = (("new_rfq", "quote_revision"), ("purchase_order", "order_followup"))


def _or_none(probs: Column) -> Column:
    return F.coalesce(probs, F.expr("cast(array() as array<struct<key:string,p:double>>)"))


def ranked(probs: Column) -> Column:
    """Options by descending probability; equal ones in their own order."""
    rows = F.transform(_or_none(probs), lambda e, i: F.struct((-e["p"]).alias("np"), i.alias("i"), e["key"].alias("key"), e["p"].alias("p")))
    return F.array_sort(rows)


def best_option(probs: Column) -> Column:
    return F.try_element_at(ranked(probs), F.lit(1))["key"]


def expected_score(probs: Column) -> Column:
    """The sum of level times probability, in the options' order; null without options."""
    total = F.aggregate(_or_none(probs), F.lit(0.0), lambda a, e: a + e["key"].cast("int") * e["p"])
    return F.when(F.size(_or_none(probs)) > 0, total)


def _spread(p: Column, k: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k * p - 1.0) / (k - 1.0)))


def confidence(probs: Column) -> Column:
    """(k * max - 1) / (k - 1), clamped to 0..1; 1 for a single option, null for none."""
    k = F.size(_or_none(probs))
    top = F.array_max(F.transform(_or_none(probs), lambda e: e["p"]))
    return F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(1.0)).otherwise(_spread(top, F.when(k > 1, k)))


def pair_of(r: Column) -> Column:
    """(p, confidence, a, b) of the two likeliest of ranked options where both lead to the same lane, else null."""
    a, b, k = F.try_element_at(r, F.lit(1)), F.try_element_at(r, F.lit(2)), F.size(r)
    same = F.lit(False)
    for x, y in SAME_LANE:
        same = same | ((a["key"] == x) & (b["key"] == y)) | ((a["key"] == y) & (b["key"] == x))
    both = a["p"] + b["p"]
    return F.when(same, F.struct(both.alias("p"), _spread(both, F.when(k > 1, k)).alias("confidence"), a["key"].alias("a"), b["key"].alias("b")))


def pair(probs: Column) -> Column:
    return pair_of(ranked(probs))


def top_two_of(r: Column, labels: dict[str, str]) -> Column:
    """`A 46% vs B 46%`, of ranked options."""
    said = lambda i: F.concat(label_of(F.try_element_at(r, F.lit(i))["key"], labels), F.lit(" "), pct(F.try_element_at(r, F.lit(i))["p"]))
    return F.concat_ws(" vs ", F.when(F.size(r) > 0, said(1)), F.when(F.size(r) > 1, said(2)))


def top_two(probs: Column, labels: dict[str, str]) -> Column:
    return top_two_of(ranked(probs), labels)


def normal_choice(raw: Column) -> Column:
    """A choice answer (choice, confidence, probabilities) with what is missing filled in."""
    given, first = F.nullif(raw["choice"], F.lit("")), F.try_element_at(ranked(raw["probabilities"]), F.lit(1))
    choice = F.coalesce(given, first["key"])
    p = F.when(given.isNull(), first["p"]).otherwise(F.try_element_at(F.filter(_or_none(raw["probabilities"]), lambda e: e["key"] == given), F.lit(1))["p"])
    return F.struct(
        choice.alias("choice"),
        p.alias("p"),
        F.coalesce(raw["confidence"], confidence(raw["probabilities"])).alias("confidence"),
        raw["confidence"].isNull().alias("confidence_estimated"),
        _or_none(raw["probabilities"]).alias("probabilities"),
    )


def normal_score(raw: Column, criteria: Column) -> Column:
    """A score answer (score, confidence, probabilities, legend) likewise; the legend from the question."""
    legend = F.map_from_entries(F.transform(criteria, lambda c, i: F.struct(i.cast("string").alias("k"), c.alias("v"))))
    return F.struct(
        F.coalesce(raw["score"], expected_score(raw["probabilities"])).alias("score"),
        F.coalesce(raw["confidence"], confidence(raw["probabilities"])).alias("confidence"),
        raw["confidence"].isNull().alias("confidence_estimated"),
        _or_none(raw["probabilities"]).alias("probabilities"),
        F.coalesce(raw["legend"], legend).alias("legend"),
    )


def normal_noul(raw: Column) -> Column:
    """A yes/no answer: its probability under either name."""
    return F.struct(F.coalesce(raw["noul"], raw["probability"]).alias("p"))
