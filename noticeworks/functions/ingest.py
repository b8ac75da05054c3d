"""Field maps compiled to columns: paths, dates, prices, masks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Key names of personal data, and targets that a map must not have.
PII_KEYS = r"(?i)(ofcl|manager|charger|picnm|pic_?tel|refrnc|telno|celno|mbr|담당자|연락처|휴대폰|이메일|e-?mail)"
PII_ALLOWED = ("deptnm", "deptname", "orgnm", "orgname", "sorgnnm", "ntceinsttnm")
MASK = "[개인정보 마스킹됨]"
BANNED = frozenset("manager_name manager_tel manager_email manager_phone contact_name contact_tel contact_email contact_phone ofcl_name ofcl_tel ofcl_email".split())
BANNED_TIER_B = frozenset("body content description full_text detail_text spec_text".split())
REQUIRED = ("title", "org_name", "url")
DATES = ("open_dt", "close_dt")
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def pii_key(key: Column) -> Column:
    return ~F.lower(key).isin(*PII_ALLOWED) & key.rlike(PII_KEYS)


def masked(attributes: Column) -> Column:
    """A map with the values of keys that look like personal data masked."""
    return F.transform_values(attributes, lambda k, v: F.when(pii_key(k), MASK).otherwise(v))


def is_personal(key: str) -> bool:
    return key.lower() not in PII_ALLOWED and re.search(PII_KEYS, key) is not None


def masked_value(value):
    """A JSON value with all that stands under a personal key masked, whatever its type, at any depth."""
    held = [value]
    pending = [held]
    while pending:
        inside = pending.pop()
        for at in list(inside) if isinstance(inside, dict) else range(len(inside)):
            if isinstance(inside, dict) and is_personal(at):
                inside[at] = MASK
            elif isinstance(inside[at], (dict, list)):
                pending.append(inside[at])
    return held[0]


def masked_json(text: Column) -> Column:
    """A JSON text, masked like masked_value; texts without a personal key stay as they are, and what cannot be read as JSON is masked whole."""

    @F.pandas_udf("string")
    def read(bodies: pd.Series) -> pd.Series:
        return bodies.map(_masked_text)

    # Escapes may hide a key.
    suspect = text.rlike(PII_KEYS) | F.contains(text, F.lit("\\u"))
    return F.coalesce(read(F.when(suspect, text)), text)


def _masked_text(body: str | None) -> str | None:
    if body is None:
        return None
    try:
        return json.dumps(masked_value(json.loads(body)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return json.dumps(MASK, ensure_ascii=False)


def first_match(value: Column, path: str) -> Column:
    """The first value that a JSON path leads to, wildcards in arrays included; null if there is none.  Objects and arrays come as JSON text."""
    head, star, rest = path.partition("[*]")
    found = F.get_json_object(value, head)
    if not star:
        return found
    parts = F.from_json(found, "array<string>")
    led = F.transform(parts, lambda v: first_match(v, f"${rest}")) if rest else parts
    return F.get(F.filter(led, lambda v: v.isNotNull()), 0)


def resolve(item: Column, path: str) -> Column:
    """const: literal, urlfmt: template over top-level keys (null if one is missing), else a JSON path."""
    if path.startswith("const:"):
        return F.lit(path[6:])
    if path.startswith("urlfmt:"):
        parts = re.split(r"\{(\w+)\}", path[7:])
        return F.concat(*[F.get_json_object(item, f"$.{p}") if k % 2 else F.lit(p) for k, p in enumerate(parts)])
    return first_match(item, path)


def parse_date(value: Column, pattern: str | None) -> Column:
    """A date in a strptime pattern; unreadable ones and years from 9999 on are null."""
    pattern = pattern or "%Y%m%d%H%M"
    for ours, theirs in STRPTIME.items():
        pattern = pattern.replace(ours, theirs)
    found = F.try_to_timestamp(value.cast("string"), F.lit(pattern)).cast("timestamp_ntz")
    return F.when(F.year(found) < 9999, found)


def parse_price(value: Column) -> Column:
    """Commas and spaces aside, cut to a whole number; unreadable ones are null."""
    return F.trim(F.regexp_replace(value.cast("string"), ",", "")).try_cast("double").try_cast("bigint")


def refused(target: Column, legal_tier: Column) -> Column:
    """Whether a target must not be mapped: personal data, extra keys that look like it, or whole texts under tier B."""
    extra = target.startswith("extra:") & pii_key(F.substr(target, F.lit(7)))
    return target.isin(*BANNED) | extra | (F.coalesce(legal_tier == "B", F.lit(False)) & target.isin(*BANNED_TIER_B))


def validate(field_maps: Iterable[tuple[str, str, str | None]], legal_tier: str | None = None) -> None:
    """Refuses maps that would keep personal data or, for tier B, whole texts."""
    targets = {t for t, _, _ in field_maps}
    extra = {t for t in targets if t.startswith("extra:") and t[6:].lower() not in PII_ALLOWED and re.search(PII_KEYS, t[6:])}
    bad = (targets & BANNED) | extra | (targets & BANNED_TIER_B if legal_tier == "B" else set())
    if bad:
        raise ValueError(f"fields that must not be mapped: {sorted(bad)}")


def compiled(item: Column, field_maps: Iterable[tuple[str, str, str | None]]) -> list[Column]:
    """Columns of a map of (target, path, format) over a JSON item; extra: targets are gathered into one map."""
    out, extra = [], []
    for target, path, hint in field_maps:
        raw = resolve(item, path)
        if target.startswith("extra:"):
            extra += [F.lit(target[6:]), raw]
        elif target in DATES:
            out.append(parse_date(raw, hint).alias(target))
        elif target == "est_price":
            out.append(parse_price(raw).alias(target))
        else:
            out.append(raw.alias(target))
    return [*out, F.create_map(*extra).alias("extra")] if extra else out


def complete(required=REQUIRED) -> Column:
    """Whether all required fields are there and not blank."""
    good = F.lit(True)
    for name in required:
        good &= F.coalesce(F.trim(F.col(name)) != "", F.lit(False))
    return good


def reject_reason(status: Column, wanted, start: Column, begin: Column, close: Column, now: Column) -> Column:
    """Why an item is not taken; null if it is."""
    odd = F.coalesce(~status.isin(*wanted), F.lit(False))
    return F.when(odd, "status").when(start < begin, "out_of_window").when(close < now, "already_closed")
