"""Agreement of two sets of labels by field, and statistics of rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import written
from .metrics import counted_kappa


def by_field(df: DataFrame, fields: list[str], *keep: str) -> DataFrame:
    """(*keep, field, a, b): one row for each field of rows with columns a_<field> and b_<field>, as strings."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").cast("string").alias("a"), F.col(f"b_{f}").cast("string").alias("b")) for f in fields])
    return df.select(*keep, F.inline(each))


def field_kappas(df: DataFrame, fields: list[str], a_rejected: Column, b_rejected: Column) -> DataFrame:
    """(field, n, agreement, kappa) of each field over the rows that neither side rejected, of the reject decision over all rows
    (field status), and the mean kappa of the fields (field mean, agreement null)."""
    marked = df.withColumns({"__ra": a_rejected, "__rb": b_rejected})
    used = by_field(marked.where("NOT __ra AND NOT __rb"), fields)
    decision = marked.select(F.lit("status").alias("field"), F.col("__ra").cast("string").alias("a"), F.col("__rb").cast("string").alias("b"))
    both = used.unionByName(decision)
    # the rows are looked at once: all else comes from the counts of pairs of values
    scores = counted_kappa(written(both.groupBy("field", "a", "b").agg(F.count("*").alias("n")), "pairs"), ["field"])
    fields_only = scores.where("field <> 'status'")
    mean = fields_only.agg(F.lit("mean").alias("field"), F.max("n").alias("n"), F.lit(None).cast("double").alias("agreement"), F.avg("kappa").alias("kappa"))
    return scores.unionByName(mean)


def field_accuracy(df: DataFrame, fields: list[str], group: str | None = None) -> DataFrame:
    """(group, field, n, accuracy) where a_<field> and b_<field> are the same string (null only like null); field all: the mean
    over the fields."""
    keys = [group] if group else []
    one = by_field(df, fields, *keys).groupBy(*keys, "field").agg(F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("double")).alias("accuracy"))
    mean = one.groupBy(*keys).agg(F.lit("all").alias("field"), F.sum("n").alias("n"), F.avg("accuracy").alias("accuracy"))
    return one.unionByName(mean)


def concrete_rates(df: DataFrame, variant: str, fields: list[str], vague: list[str], confidence: str) -> DataFrame:
    """(variant, n, concrete_rate, mean_confidence): the share of field values that are not vague, and the mean confidence."""
    share = sum((F.when(F.col(f).isin(vague) | F.col(f).isNull(), 0.0).otherwise(1.0) for f in fields), F.lit(0.0)) / len(fields)
    return df.groupBy(variant).agg(F.count("*").alias("n"), F.avg(share).alias("concrete_rate"), F.avg(confidence).alias("mean_confidence"))


def unanimous(df: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """(field, n, share): of items with several rows, the share whose rows all have one value of the field."""
    v = lambda f: F.col(f).cast("string")
    own = df.groupBy(item).agg(F.count("*").alias("rows"), *[g(v(f)).alias(f"{n}{i}") for i, f in enumerate(fields) for n, g in (("lo", F.min), ("hi", F.max), ("set", F.count))])
    same = lambda i: ((F.col(f"set{i}") == 0) | ((F.col(f"set{i}") == F.col("rows")) & (F.col(f"lo{i}") == F.col(f"hi{i}")))).cast("double")
    each = own.where("rows > 1").agg(F.count("*").alias("n"), *[F.avg(same(i)).alias(f"share{i}") for i in range(len(fields))]).where("n > 0")
    return each.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col("n"), F.col(f"share{i}").alias("share")) for i, f in enumerate(fields)])))


def predictability(df: DataFrame, given: str, target: str) -> DataFrame:
    """(given, n, modal, modal_share, total_share): the most frequent target of each value (of equal ones the smallest), and over
    all rows the share that this guess gets right."""
    n = df.groupBy(given, target).agg(F.count("*").alias("n"))
    top = n.groupBy(given).agg(F.sum("n").alias("rows"), F.min(F.struct((-F.col("n")).alias("o"), F.col(target).alias("t"))).alias("m")).select(given, "rows", F.col("m.t").alias("modal"), (-F.col("m.o")).alias("hits"))
    whole = top.agg((F.sum("hits") / F.sum("rows")).alias("total_share"))  # one row a value of given before
    return top.join(F.broadcast(whole), F.lit(True)).select(given, F.col("rows").alias("n"), "modal", (F.col("hits") / F.col("rows")).alias("modal_share"), "total_share")


def drivers(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(combination, n, share) of the parts of a disjunction that hold together, of the rows where any holds; single parts as
    combination any:<part>."""
    hits = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in parts.items()])))
    fired = df.select(hits.alias("h")).where(F.size("h") > 0)
    names = fired.select(F.explode(F.concat(F.array(F.array_join("h", "+")), F.transform("h", lambda p: F.concat(F.lit("any:"), p)))).alias("combination"))
    counts = names.groupBy("combination").agg(F.count("*").alias("n"))
    total = fired.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("combination", "n", (F.col("n") / F.col("total")).alias("share"))


def composition(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, share) of each value of some columns."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    total = df.agg(F.count("*").alias("total"))
    return each.groupBy("column", "value").agg(F.count("*").alias("n")).join(F.broadcast(total), F.lit(True)).select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def ruleset_stats(df: DataFrame, label: Column, found: Column, rule: Column, pure: Column, cls: str, beside: str) -> DataFrame:
    """One row: the share of rows with several candidates; of rows labelled beside, how many have cls as a candidate; of rows labelled
    cls, how many are pure; how often the rule of cls holds against how often it is the label."""
    rows = df.select(label.alias("l"), found.alias("c"), F.coalesce(rule, F.lit(False)).alias("r"), F.coalesce(pure, F.lit(False)).alias("p"))
    is_cls, is_beside = F.col("l") == cls, F.col("l") == beside
    s = rows.agg(F.count("*").alias("n"), F.avg((F.size("c") > 1).cast("double")).alias("multi_fire_rate"), F.count_if(is_beside).alias("n_beside"), F.count_if(is_beside & F.array_contains("c", cls)).alias("n_ambiguous"), F.count_if(is_cls).alias("n_labelled"), F.count_if(is_cls & F.col("p")).alias("n_pure"), F.count_if("r").alias("true_by_rule"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return s.select("*", ratio("n_ambiguous", "n_beside").alias("ambiguous_rate"), ratio("n_pure", "n_labelled").alias("purity"), ratio("true_by_rule", "n_labelled").alias("undercrediting"))
