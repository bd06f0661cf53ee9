"""Generic rules over documents and inventories, as columns and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import decision, findings

#: A date and time with an offset from UTC.
OFFSET_TIME = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)\z"


def exact_singleton(scalar: Column, array: Column, expected: str) -> Column:
    """Whether a value that is either a scalar or an array is `expected`, or an array of that alone."""
    return F.coalesce(scalar == expected, F.lit(False)) | F.coalesce((F.size(array) == 1) & (F.element_at(array, 1) == expected), F.lit(False))


def offset_time(text: Column) -> Column:
    """The time that a text with an offset names; null for other texts."""
    return F.when(text.rlike(OFFSET_TIME), F.try_to_timestamp(text))


def fresh(text: Column, now: Column, hours: int = 24) -> Column:
    """Whether a time lies in the hours up to now; false if it can't be read."""
    at = offset_time(text)
    return F.coalesce((at <= now) & (at >= now - F.make_interval(hours=F.lit(hours))), F.lit(False))


def quota_rows(documents: DataFrame) -> DataFrame:
    """Quotas with a number, of documents (service, Quotas), in the order of code and name."""
    rows = documents.select("service", F.inline("Quotas"))
    named = {"QuotaCode": "code", "QuotaName": "name", "Unit": "unit", "Value": "value", "Adjustable": "adjustable", "GlobalQuota": "global"}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("adjustable", "global")}
    return rows.where("Value IS NOT NULL").withColumnsRenamed(named).withColumns(flags).select("service", *named.values()).orderBy("service", "code", "name")


def quota_gaps(quotas: DataFrame, wanted: DataFrame) -> DataFrame:
    """Services of wanted (service, part) without a positive quota whose name has one of the parts."""
    met = quotas.join(wanted, "service").where((F.col("value") > 0) & F.contains(F.lower("name"), F.col("part"))).select("service")
    return wanted.select("service").distinct().join(met, "service", "left_anti")


def cost_findings(components: DataFrame, amount: str, total: float, ceiling: float, cap: float) -> list[str]:
    """What is wrong with a forecast: parts that don't sum to it, or limits that don't rise."""
    summed = components.agg(F.coalesce(F.sum(F.col(amount).cast("double")), F.lit(0.0))).first()[0]
    found = ["cost arithmetic mismatch"] if abs(summed - total) > 1e-9 else []
    return found + ([] if total < ceiling < cap else ["cost thresholds are invalid or exceeded"])


def included(path: Column, prefixes: list[str], exact: list[str], suffixes: list[str]) -> Column:
    """Whether a path belongs to a manifest: by prefix or name, unless it has one of the suffixes."""
    wanted = F.lit(False)
    for p in prefixes:
        wanted = wanted | path.startswith(p)
    for s in suffixes:
        wanted = wanted & ~path.endswith(s)
    return path.isin(exact) | wanted


def boundary(contract: DataFrame, expected: list[str], wanted: str) -> DataFrame:
    """The row of one id in a contract table (id, ...), whose ids must be exactly the expected ones."""
    ids = F.array_sort(F.collect_list("id"))
    if contract.agg(ids.alias("ids")).first()["ids"] != sorted(expected):
        raise ValueError("the contract's ids are not the expected ones")
    return contract.where(F.col("id") == wanted)


@dataclass(frozen=True)
class Rule:
    """What is wanted of the value at a path of a document, and what is found where it isn't so.

    Operators: equals, one_of (a list of texts), at_least, below (numbers), only (an array of this alone, or a scalar),
    fresh (a time with an offset, in the hours up to now), present.
    """

    path: str
    operator: str
    value: object
    finding: str

    def holds(self, document: Column, now: Column) -> Column:
        """Whether it holds; null where the value is missing or of another type, so that nothing can be said."""
        at = lambda kind: F.try_variant_get(document, self.path, kind)
        if self.operator == "equals":
            return at("string") == F.lit(str(self.value))
        if self.operator == "one_of":
            return at("string").isin(list(self.value))
        if self.operator == "at_least":
            return at("double") >= F.lit(float(self.value))
        if self.operator == "below":
            return at("double") < F.lit(float(self.value))
        if self.operator == "only":
            array, scalar = at("array<string>"), at("string")
            return F.when(array.isNotNull() | scalar.isNotNull(), exact_singleton(F.when(array.isNull(), scalar), array, str(self.value)))
        if self.operator == "fresh":
            return F.when(offset_time(at("string")).isNotNull(), fresh(at("string"), now, int(self.value)))
        if self.operator == "present":
            return F.when(document.isNotNull(), at("string").isNotNull() | at("array<variant>").isNotNull())
        raise ValueError(f"no operator {self.operator}")


def decided(documents: DataFrame, rules: list[Rule], now: Column) -> DataFrame:
    """documents (document VARIANT, error) with `decision` and `findings`, by a table of rules.

    A document that can't be read, or a value that a rule needs and that is missing or of another type, leaves the
    decision INDETERMINATE; a rule that doesn't hold makes it NO_GO; else it is ADMITTED. Findings are distinct and sorted.
    """
    held = [(r, r.holds(F.col("document"), now)) for r in rules]
    unread = F.col("error").isNotNull() | F.col("document").isNull()
    errors = F.when(unread, F.array(F.concat(F.lit("unreadable: "), F.coalesce("error", F.lit("no document"))))).otherwise(
        F.array_compact(F.array(*[F.when(h.isNull(), F.lit(f"{r.finding}: nothing to judge")) for r, h in held]))
    )
    gaps = F.when(unread, F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(~h, F.lit(r.finding)) for r, h in held])))
    judged = documents.withColumn("_errors", errors).withColumn("_gaps", gaps)
    return judged.withColumn("decision", decision(F.col("_errors"), F.col("_gaps"))).withColumn("findings", findings(F.col("_errors"), F.col("_gaps"))).drop("_errors", "_gaps")
