"""Where answers come from: keyword rules as native expressions (the default), or a model over HTTP."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame

from ..functions import lazy as F

from ..schemas import ANSWERS, EMAIL_TYPE_LABELS, VOLUME_LABELS, Shop

#: The rules' words, first match first.
EXPORT = r"\bitar\b|\bcui\b|\bear\b|eccn|export|dfars|u\.s\. persons|arms export"
EXPORT_PITCH = (r"we are itar registered|itar registered", r"our services|we offer|special pricing|capabilit")
QUANTITY = r"\b\d[\d,]*\s*(pcs|pieces|each|ea|units|parts)\b|qty|quantit|annual|/yr|per year|\d+\s*/\s*\d+"
DRAWINGS = r"engineering drawing|\.step|\.stp|drawing attached|attached drawing|dwg no|3d model"
FINISHES = r"anodiz|plat(e|ed|ing)\b|passivat|heat treat|powder coat|chem film|black oxide|electroless|paint"
PITCH = r"new job|resume|hiring|staffing|promo|% off|webinar|newsletter|expo|demo this week|our services|unsubscribe|lunch|parking|gift card|verify your account"
PO, ASKS = r"\bpo\b|purchase order|please proceed|award", r"quote|rfq|pricing"
QUOTE_SUBJECT, ORDER_SUBJECT = r"\brfq\b|quote|pricing|price", r"\bpo\b|status|tracking|invoice"
REVISED_SUBJECT = r"\bre:|revis|rev [a-z]\b.*(update|now)|update"
FOLLOWUP = r"status|tracking|ship date|shipped|certs|certification|invoice|fai report|on track|rma|nonconform|change order"
REVISED = r"rev [a-z]\b.*(update|revise)|revised|revision|update(d)? quote"
QUOTE = r"quote|rfq|pricing|price|can you make"
VAGUE = r"can you make|what would .* cost|can you do this"
PROCESSES = (
    ("mixed_or_unclear", r"weld|fabricat|sheet metal|casting|foundry|3d print|injection mold|molded"),
    ("milling_5axis", r"5-axis|five-axis|impeller|implant|contour|sculpt|compound|blade|vane|wing rib|structural fitting"),
    ("turning", r"shaft|\bpins?\b|bushing|spacer|lathe|turn(ed|ing)|swiss|nozzle|gear blank|roller|\bstuds?\b"),
    ("milling_3axis", r"plate|bracket|block|housing|cover|manifold|heat sink|heatsink|fixture|enclosure"),
)
COUNTED = r"\b(\d[\d,]{0,6})\s*(?:pcs|pieces|each|ea|/yr|per year|units)"
URGENCY = (r"due|by \w+ \d|within|weeks", r"this week|by friday|end of the week|few days", r"urgent|asap|line down|aog|rush|expedite|today|tomorrow")


#: What makes an alternative of a pattern more than plain text.
_SPECIAL = set("\\.[](){}*+?^$|")


def _alternatives(pattern: str) -> list[str]:
    """The pattern's alternatives, parted at bars that stand in no group or class."""
    out, depth, held, i = [], 0, "", 0
    while i < len(pattern):
        step = 2 if pattern[i] == "\\" else 1
        c = pattern[i : i + step]
        depth += (c in ("(", "[")) - (c in (")", "]"))
        if c == "|" and not depth:
            out.append(held)
            held = ""
        else:
            held += c
        i += step
    return [*out, held]


def _needed(alternative: str) -> tuple[str, bool]:
    """The longest plain text that whatever matches must hold, and whether it is all of the alternative."""
    runs, run, depth, i = [], "", 0, 0
    whole = True
    while i < len(alternative):
        step = 2 if alternative[i] == "\\" else 1
        c = alternative[i : i + step]
        i += step
        plain = c[1] if step == 2 and not c[1].isalnum() else c if c not in _SPECIAL and step == 1 else None
        optional = alternative[i : i + 1] in ("?", "*", "{")
        if plain is not None and not depth and not optional and alternative[i : i + 1] != "+":
            run += plain
            continue
        whole = False
        runs.append(run + (plain if plain is not None and not depth and not optional else ""))
        run = ""
        depth += (c in ("(", "[")) - (c in (")", "]"))
    return max([*runs, run], key=len), whole


def has(pattern: str, text: Column) -> Column:
    """Whether a pattern is found: an alternative that is plain text by a search of bytes; any other by a
    regular expression, but only in texts that hold the plain part it needs. Null has nothing."""
    any_ = None
    for alternative in _alternatives(pattern):
        needed, whole = _needed(alternative)
        found = F.contains(text, F.lit(needed)) if len(needed) > 1 or whole else None
        if not whole:
            match = F.regexp_like(text, F.lit(alternative))
            found = match if found is None else found & match
        any_ = found if any_ is None else any_ | found
    return F.coalesce(any_, F.lit(False))


def _choice(winner: Column, options: list[str], strength: Column) -> Column:
    """A choice answer: the winner's option comes first, the others in their order. A winner that is no option
    is the first one."""
    k, names, cases = len(options), lambda first: F.array(*map(F.lit, [first, *(o for o in options if o != first)])), F
    for o in options:
        cases = cases.when(winner == o, names(o))
    whole = cases.otherwise(names(options[0]))
    rest = F.round((1.0 - strength) / max(1, k - 1), 4)
    sure = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (k * strength - 1.0) / (k - 1.0))), 4) if k > 1 else F.lit(1.0)

    def made(names: Column) -> Column:
        probs = F.transform(names, lambda o, i: F.struct(o.alias("key"), F.when(i == 0, strength).otherwise(rest).alias("p")))
        return F.struct(F.get(names, F.lit(0)).alias("choice"), strength.alias("p"), sure.alias("confidence"), F.lit(False).alias("confidence_estimated"), probs.alias("probabilities"))

    return F.let(whole, made)


def keyword_answers(state: Column, shop: Shop) -> Column:
    """The answers of the keyword rules for a state (subject, body, attachments): one struct, no Python. The
    text is put in lower case once, and what the rules find is found once."""
    texts = F.struct(F.lower(F.to_json(state)).alias("text"), F.lower(state["subject"]).alias("subject"), F.lower(F.concat_ws(" ", state["subject"], state["body"])).alias("body"))
    return F.let(texts, lambda t: F.let(_found(t["text"], t["subject"], t["body"]), lambda f: _answers(f, shop)))


def _found(text: Column, subject: Column, body: Column) -> Column:
    """What the rules find, first match first. The probabilities."""
    export = F.when(has(EXPORT_PITCH[0], text) & has(EXPORT_PITCH[1], text), F.lit(0.55)).when(has(EXPORT, text), F.lit(0.92)).otherwise(F.lit(0.04))
    kind = (
        F.when(has(PITCH, body), F.lit("vendor_or_solicitation"))
        .when(has(PO, body) & ~has(ASKS, body), F.lit("purchase_order"))
        .when(has(QUOTE_SUBJECT, subject) & ~has(ORDER_SUBJECT, subject), F.when(has(REVISED_SUBJECT, subject), F.lit("quote_revision")).otherwise(F.lit("new_rfq")))
        .when(has(FOLLOWUP, body), F.lit("order_followup"))
        .when(has(REVISED, body), F.lit("quote_revision"))
        .when(has(QUOTE, body), F.lit("new_rfq"))
        .otherwise(F.lit("other"))
    )
    process = None
    for source in (body, text):  # the message decides; its attachments break a tie
        for lane, pattern in PROCESSES:
            process = F.when(has(pattern, source), F.lit(lane)) if process is None else process.when(has(pattern, source), F.lit(lane))
    process = process.otherwise(F.lit("mixed_or_unclear"))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(COUNTED), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).cast("long"))
    # digits are rare in prose, and no count is without one
    most = F.when(F.regexp_like(text, F.lit(r"\d")), F.array_max(numbers))
    level = F.when(has(URGENCY[2], body), F.lit(3)).when(has(URGENCY[1], body), F.lit(2)).when(has(URGENCY[0], body), F.lit(1)).otherwise(F.lit(0))
    return F.struct(
        kind.alias("kind"), process.alias("process"), export.alias("export"), most.alias("most"), level.alias("level"), F.when(has(VAGUE, body), F.lit(0.45)).otherwise(F.lit(0.82)).alias("strength"),
        has(QUANTITY, text).alias("quantity"), has(DRAWINGS, text).alias("drawings"), has(FINISHES, text).alias("finishes"),
    )


def _answers(f: Column, shop: Shop) -> Column:
    """Answers from what was found. Strengths, probabilities, and the limits of volumes."""
    yes = lambda when, p, q: F.struct(F.when(when, F.lit(p)).otherwise(F.lit(q)).alias("p"))
    volume = F.when(f["most"].isNull(), F.lit("not_stated")).when(f["most"] > 250, F.lit("production")).when(f["most"] > 10, F.lit("low_volume")).otherwise(F.lit("prototype"))
    levels = F.array(*[F.struct(F.lit(str(i)).alias("key"), F.when(f["level"] == i, F.lit(0.76)).otherwise(F.lit(0.08)).alias("p")) for i in range(4)])
    score = F.round(F.aggregate(levels, F.lit(0.0), lambda s, e: s + e["key"].cast("int") * e["p"]), 4)
    return F.struct(
        _choice(f["kind"], list(EMAIL_TYPE_LABELS), f["strength"]).alias("email_type"),
        _choice(f["process"], list(shop.process_labels()), F.lit(0.78)).alias("process"),
        F.struct(f["export"].alias("p")).alias("export_controlled"),
        F.struct(score.alias("score"), F.lit(0.68).alias("confidence"), F.lit(False).alias("confidence_estimated"), levels.alias("probabilities"), F.lit(None).cast("map<string,string>").alias("legend")).alias("urgency"),
        yes(f["quantity"], 0.88, 0.12).alias("quantity_given"),
        yes(f["drawings"], 0.9, 0.15).alias("drawings_provided"),
        yes(f["finishes"], 0.85, 0.1).alias("outside_processing"),
        _choice(volume, list(VOLUME_LABELS), F.lit(0.7)).alias("volume"),
    )


@dataclass
class Pacing:
    """Waits of an HTTP decider, in seconds: the pace after the first refusal, the waits before the same
    call is tried again, and those after passing errors (which end). Fixed values: the defaults."""

    pace: float = 61.0
    refused: tuple[float, ...] = (60, 60, 90, 120, 180, 300)
    passing: tuple[float, ...] = (2, 4, 8)
    timeout: float = 20.0


#: Error kinds that end a run, and those that pass.
FATAL, PASSING = ("auth", "billing", "not_found"), ("overloaded", "server", "timeout", "network")


def refusal_wait(pacing: Pacing, attempt: int, retry_after: float | None) -> float:
    """At least what the service asked for (0 counts as nothing), and never below the pace."""
    return max(retry_after or pacing.refused[min(attempt, len(pacing.refused) - 1)], pacing.pace)


def ask(call: Callable[[dict], dict], payload: dict, pacing: Pacing, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One answered call: {"answers": ...} or {"error": kind, ...}. Refusals are tried again without end,
    passing errors three times, fatal ones not at all."""
    refused = passing = 0
    while True:
        out = call(payload)
        kind = out.get("error")
        if kind == "rate_limit":
            sleep(refusal_wait(pacing, refused, out.get("retry_after")))
            refused += 1
        elif kind in PASSING and passing < len(pacing.passing):
            sleep(pacing.passing[passing] * (1 + 0.1 * random.random()))
            passing += 1
        else:
            return out


def http_answers(states: DataFrame, call: Callable[[dict], dict], pacing: Pacing | None = None, in_flight: int = 1) -> DataFrame:
    """(key, state) to (key, answers, error): misses only belong here, since Spark cannot push an anti-join
    below Python. `in_flight` partitions call at once. call: payload to {"answers": ...} or {"error": kind,
    "retry_after": seconds}; it is pickled to the executors."""
    pacing = pacing or Pacing()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped = None
        for frame in frames:
            rows = []
            for key, state in zip(frame["key"], frame["state"]):
                out = {"error": stopped} if stopped else ask(call, {"state": json.loads(state)}, pacing)
                if out.get("error") in FATAL:
                    stopped = out["error"]
                rows.append((key, json.dumps(out["answers"]) if "answers" in out else None, out.get("error")))
            yield pd.DataFrame(rows, columns=["key", "answers", "error"])

    asked = states.select("key", F.to_json("state").alias("state")).repartition(in_flight).mapInPandas(run, "key string, answers string, error string")
    return asked.select("key", F.from_json("answers", ANSWERS).alias("answers"), "error")
