"""Coercion of free values to closed label sets, and ordered rule sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(value: Column) -> Column:
    """Without white space at the ends: blanks, tabs and line ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def coerce_enum(value: Column, allowed: list[str]) -> Column:
    """The value lower-cased, stripped, spaces as underscores, if allowed; else unknown if that is allowed, else the last one."""
    other = "unknown" if "unknown" in allowed else allowed[-1]
    clean = F.replace(F.lower(stripped(value)), F.lit(" "), F.lit("_"))
    return F.when(clean.isin(allowed), clean).otherwise(F.lit(other))


def coerce_bool(value: Column) -> Column:
    return F.coalesce(F.lower(stripped(value.cast("string"))).isin("true", "yes", "1", "y"), F.lit(False))


def parse_answer(text: Column, schema: str) -> Column:
    """The JSON object in a model's answer: thoughts are cut out, then from the first { to the last }; null if there is none."""
    rest = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.from_json(F.nullif(F.regexp_extract(rest, r"(?s)\{.*\}", 0), F.lit("")), schema)


def parsed_record(text: Column, enums: dict[str, list[str]], flags: list[str]) -> Column:
    """struct(parsed, model_confidence, fields...) of a model's answer: every field coerced to its closed set, a missing or bad one to its
    default. Without a JSON object parsed is false, all fields have their defaults and there is no confidence; with one, the
    confidence is null where it is no number."""
    found = parse_answer(text, ", ".join([*[f"{f} string" for f in (*enums, *flags)], "model_confidence string"]))
    fields = [coerce_enum(found[f], v).alias(f) for f, v in enums.items()] + [coerce_bool(found[f]).alias(f) for f in flags]
    return F.struct(found.isNotNull().alias("parsed"), found["model_confidence"].try_cast("double").alias("model_confidence"), *fields)


def first_match(rules: list[tuple[str, Column]], other: str) -> Column:
    """Name of the first rule that holds; a null condition does not hold."""
    out = F.lit(other)
    for name, condition in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def all_matches(rules: list[tuple[str, Column]], other: str, gate: str | None = None) -> Column:
    """Names of all rules that hold, in order; never empty. If the gate rule holds, it alone counts."""
    hit = lambda c: F.coalesce(c, F.lit(False))
    found = F.array_compact(F.array(*[F.when(hit(c), F.lit(n)) for n, c in rules]))
    found = F.when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)
    gates = [c for n, c in rules if n == gate]
    return F.when(hit(gates[0]), F.array(F.lit(gate))).otherwise(found) if gates else found


def best_over_bars(probs: Column, bars: list[float]) -> Column:
    """Index of the class whose probability exceeds its bar by most (ties: higher probability, then lower index); null if none reaches it."""
    scored = F.transform(probs, lambda p, i: F.struct((p - F.get(F.array(*map(F.lit, bars)), i)).alias("d"), p.alias("p"), (-i).alias("i")))
    return -F.array_max(F.filter(scored, lambda s: s["d"] >= 0))["i"]
