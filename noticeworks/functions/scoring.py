"""Scores: strengths, noisy-OR, weighted averages, vectors, requirements and eligibility, all as columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
STRENGTH_FULL, STRENGTH_FLOOR = 10, 0.15
PRIORITY_POINTS = {"high": 40, "normal": 30, "low": 15}
TERM_POINTS, ORG_POINTS, MIN_SCORE = 25, 20, 30
OPERATORS = ("gte", "lte", "eq", "contains", "manual")


def whole(value: Column) -> Column:
    """Rounded to a whole number, ties to even; noise in the tenth decimal does not decide a tie."""
    # A double is a tie only if it is one exactly, so the plain rounding of doubles is that of decimals here.
    return F.rint(F.round(value, 9)).cast("int")


def strength(l2: Column) -> Column:
    return F.greatest(F.lit(STRENGTH_FLOOR), F.least(F.lit(1.0), l2 / F.lit(STRENGTH_FULL)))


def noisy_or(chances: Column) -> Column:
    """1 - product of (1 - p) over an array."""
    return 1 - F.aggregate(chances, F.lit(1.0), lambda acc, p: acc * (1 - p))


def combine_noisy_or(signals: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Signals of 0 to 1 by noisy-OR; negative ones suppress the result; null ones are left out; 0 without a positive one."""
    # Without a positive signal `kept` stays 1 and the result 0; no condition encloses the sum, which keeps the compiled code short.
    kept, suppressed = F.lit(1.0), F.lit(1.0)
    for name, value in signals.items():
        weight = float((weights or {}).get(name, 1.0))
        part = F.least(F.lit(1.0), F.abs(value) if weight == 1 else F.lit(weight) * F.abs(value))
        part = part if weight >= 0 else F.greatest(F.lit(0.0), part)
        kept = kept * F.when(value >= 0, 1 - part).otherwise(1.0)
        suppressed = suppressed * F.when(value < 0, 1 - part).otherwise(1.0)
    return whole((1 - kept) * suppressed * 100)


def combine_average(signals: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the signals that are known, held to 0 to 1; 0 if none is or their weights sum to nothing."""
    total, sum_weights = F.lit(0.0), F.lit(0.0)
    for name, value in signals.items():
        weight = F.lit(float((weights or {}).get(name, 1.0)))
        total = total + F.coalesce(weight * value, F.lit(0.0))
        sum_weights = sum_weights + F.when(value.isNull(), 0.0).otherwise(weight)
    mean = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.nullif(sum_weights, F.lit(0.0))))
    return F.when(sum_weights > 0, whole(mean * 100)).otherwise(0)


def floored(value: Column, least: float) -> Column:
    return F.when(F.abs(value) >= least, value)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def similarity(x: Column, y: Column) -> Column:
    """Cosine distance mapped to 0 to 1."""
    return F.greatest(F.lit(0.0), 1 - (1 - cosine(x, y)) / 2)


def weighted_pair(title: Column, attachment: Column, w_title: float = 0.6, w_attachment: float = 0.4) -> Column:
    return F.coalesce(w_title * title + w_attachment * attachment, title, attachment)


def work_type_signal(prefs: Column, work_type: Column, biz_type: Column, points: float = 0.6) -> Column:
    wanted = F.coalesce(F.try_element_at(prefs, work_type), F.try_element_at(prefs, biz_type))
    return F.when(wanted == "positive", points).when(wanted == "negative", -points)


def number(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, ",", "")).try_cast("double")


def requirement_verdict(value: Column, op: Column, product: Column, unit: Column, product_unit: Column) -> Column:
    """ok, no or unknown; whatever the rules cannot decide is unknown."""
    mine, theirs = number(product), number(value)
    same = lambda x: F.lower(F.trim(x))
    told = lambda yes: F.when(yes, "ok").otherwise("no")
    numbers = mine.isNotNull() & theirs.isNotNull()
    differ = (F.length(unit) > 0) & (F.length(product_unit) > 0) & (F.trim(unit) != F.trim(product_unit))
    chain = F.when(product.isNull() | (op == "manual") | ~op.isin(*OPERATORS) | op.isNull(), "unknown").when(differ, "unknown")
    chain = chain.when(op == "contains", told(F.contains(same(product), same(value))))
    chain = chain.when(op == "eq", told(F.when(numbers, mine == theirs).otherwise(same(product) == same(value))))
    chain = chain.when(~numbers, "unknown").when(op == "gte", told(mine >= theirs))
    return chain.otherwise(told(mine <= theirs))


def tri_state(required: Column, known: Column, met: Column) -> Column:
    """unknown if the notice or the customer does not say, ok if nothing is required, else whether it is met."""
    return F.when(required.isNull(), "unknown").when(~required, "ok").when(~known, "unknown").when(met, "ok").otherwise("no")


def size_verdict(allowed: Column, tier: Column) -> Column:
    return tri_state(F.size(allowed) > 0, tier.isNotNull(), F.array_contains(allowed, tier))


def flag_verdict(required: Column, has: Column) -> Column:
    return tri_state(required, has.isNotNull(), has)


def codes_verdict(required: Column, own: Column) -> Column:
    mine = F.coalesce(own, F.array().cast("array<string>"))
    return tri_state(F.size(required) > 0, F.size(mine) > 0, F.coalesce(F.arrays_overlap(required, mine), F.lit(False)))


def certificates_verdict(required: Column, own: Column) -> Column:
    mine = F.coalesce(own, F.array().cast("array<string>"))
    plain = lambda x: F.lower(F.trim(x))
    met = F.forall(required, lambda r: F.exists(mine, lambda o: F.contains(plain(o), plain(r)) | F.contains(plain(r), plain(o))))
    return tri_state(F.size(required) > 0, F.size(mine) > 0, met)


def overall(*verdicts: Column) -> Column:
    axes = F.array(*verdicts)
    return F.when(F.array_contains(axes, "no"), "no").when(F.array_contains(axes, "unknown"), "unknown").otherwise("ok")


def axis_values(restricted: Column, values: Column, cite: Column, valid=None) -> Column:
    """Values of an extracted restriction: null without a citation, empty if there is none, else those that are valid."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != "") & (v.isin(*valid) if valid else F.lit(True)))
    cited = F.length(F.trim(cite)) > 0
    return F.when(restricted & cited, kept).when(~restricted, F.array().cast("array<string>"))


def axis_flag(required: Column, cite: Column) -> Column:
    return F.when(required & (F.length(F.trim(cite)) > 0), True).when(~required, False)


def capped(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


# The longest texts of a requirement's fields.
LONGEST = {"category": 50, "req_value": 100, "req_unit": 20}


def stripped(text: Column) -> Column:
    """Without white space of any script at both ends; null if nothing is left."""
    return F.nullif(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def valid_items(items: Column) -> Column:
    """Struct of the valid items of an array (category, req_text, req_value, req_unit, op, cite, task_ref) and the number skipped.

    An item needs a category, a text, a citation and a known operator; long fields are cut with a mark, never dropped.  A null item is skipped, a null array is empty."""
    names = ("category", "req_text", "req_value", "req_unit", "cite", "task_ref")
    cut = lambda value, name: capped(value, LONGEST[name]) if name in LONGEST else value
    tidy = F.transform(items, lambda i: F.struct(*[cut(stripped(i[name]), name).alias(name) for name in names], i["op"].alias("op")))
    good = F.filter(tidy, lambda i: i["category"].isNotNull() & i["req_text"].isNotNull() & i["cite"].isNotNull() & F.coalesce(i["op"].isin(*OPERATORS), F.lit(False)))
    count = lambda array: F.coalesce(F.array_size(array), F.lit(0))
    return F.struct(good.alias("valid"), (count(items) - count(good)).alias("skipped"))


def grounded(cite: Column, source: Column) -> Column:
    """Whether a citation stands in the source, white space aside; an empty one does not."""
    bare = lambda x: F.regexp_replace(x, r"\s+", "")
    return F.coalesce((F.length(cite) > 0) & (F.length(source) > 0) & F.contains(bare(source), bare(cite)), F.lit(False))
