"""Tables as they leave: which columns (C30), under which headers, and every value as text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digits, dashed, no_text, present

# Columns of an export by default, in order; of contacts; of what enrichment says; and the order of all others.
DEFAULT_COLUMNS = ["name", "email", "phone", "title", "profileUrl"]
CORE_COLUMNS = ["name", "email", "phone", "title", "location", "profileUrl"]
ENRICHMENT_COLUMNS = ["enrichedAt", "actionsSummary", "confidence", "fieldsEnrichedCount", "fieldsCleanedCount"]
STANDARD_ORDER = [
    "name", "email", "phone", "title", "location", "domain", "domainType", "bio", "education", "practiceAreas", "barAdmissions",
    "profileUrl", "sourceUrl", "sourcePage",
]
# Headers that differ from the column's name in words.
HEADERS = {"profileUrl": "Profile URL", "sourceUrl": "Source URL", "actionsSummary": "Actions", "fieldsEnrichedCount": "Fields Enriched", "fieldsCleanedCount": "Fields Cleaned"}


def camel(name: str) -> str:
    """profile_url as profileUrl; a name that begins with an underscore stays."""
    return name if name.startswith("_") else re.sub(r"_(\w)", lambda m: m[1].upper(), name)


def header(name: str) -> str:
    """The header of a column by its camelCase name."""
    text = re.sub(r"([A-Z])", r" \1", name)
    return HEADERS.get(name) or (text[:1].upper() + text[1:]).strip()


def select_export_columns(df: DataFrame, columns: list[str] | None = None, core: bool = False, every: bool = False, enrichment: bool = False, exclude: list[str] | None = None) -> list[str]:
    """camelCase names, in order. Those asked for (or what enrichment says), else the core, else all, else the default ones, of the
    columns that have a value in any row; enrichment columns are added to all but the core; then the excluded ones go.

    Present columns are found in one aggregate over all rows. Structs and maps, `row_id` and names with an underscore first are no columns;
    an empty table counts as having the core.
    """
    kinds = {camel(c): (c, t) for c, t in df.dtypes}
    plain = [k for k, (c, t) in kinds.items() if not t.startswith(("struct", "map")) and not c.startswith("_") and c != "row_id"]
    counts = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(f"`{kinds[k][0]}`")).alias(f"c{i}") for i, k in enumerate(plain))).first()
    have = [k for i, k in enumerate(plain) if counts[f"c{i}"]] if counts["n"] else list(CORE_COLUMNS)
    if columns:
        names = [c for c in map(camel, columns) if c in have or c in ENRICHMENT_COLUMNS]
    else:
        names = [c for c in (have if every else CORE_COLUMNS if core else DEFAULT_COLUMNS) if c in have]
    if enrichment and not core:
        names += [c for c in ENRICHMENT_COLUMNS if c not in names]
    names = [c for c in dict.fromkeys(names) if c not in map(camel, exclude or [])]
    order = {c: i for i, c in enumerate(dict.fromkeys([*DEFAULT_COLUMNS, *STANDARD_ORDER]))}
    return sorted(names, key=lambda c: (order.get(c, len(order)), c))


def shown_phone(c: Column) -> Column:
    """Ten digits, or eleven from a 1, as +1-AAA-BBB-CCCC; others as they are."""
    d = digits(c)
    ten = F.when(F.length(d) == 10, d).when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10))
    return F.coalesce(dashed(ten), c)


def shown_date(c: Column, kind: str) -> Column:
    """Dec 9, 2025 6:10 PM, in the session's time zone; a text that is no time stays."""
    at = c if kind.startswith("timestamp") else c.cast("timestamp") if kind == "date" else c.try_cast("timestamp")
    shown = F.date_format(at, "MMM d, yyyy h:mm a")
    return shown if kind.startswith("timestamp") or kind == "date" else F.coalesce(shown, c.cast("string"))


def shown_value(c: Column, kind: str) -> Column:
    """Lists with commas, nested values as JSON, whole numbers without a fraction, others as text."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.array_join(F.transform(c, lambda x: F.coalesce(shown_value(x, inner), F.lit(""))), ", " if not inner.startswith("array<") else ",")
    if kind.startswith(("struct", "map")):
        return F.to_json(c)
    if kind in ("double", "float"):
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def shown_actions(actions: Column) -> Column:
    """field:ACTION with commas, without what changed nothing."""
    told = F.filter(F.map_entries(actions), lambda e: e["value"].isNotNull() & ~e["value"].isin("UNCHANGED", "BOTH_MISSING"))
    return F.array_join(F.transform(told, lambda e: F.concat_ws(":", e["key"], e["value"])), ", ")


def format_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """row_id if there is one, and the columns of camelCase names as text; null is ''.

    Enrichment columns come from the struct `enrichment` (enrichedAt, actions map<string,string>, confidence as text or a struct with
    `overall`) and from it alone; without it they are ''.
    """
    kinds = {camel(c): (F.col(f"`{c}`"), t) for c, t in df.dtypes}
    said = {f.name: f.dataType.simpleString() for f in df.schema["enrichment"].dataType} if "enrichment" in df.columns else {}
    e = F.col("enrichment")
    counted = lambda a: F.when(e.isNotNull(), F.size(F.filter(F.coalesce(F.map_values(e["actions"]), F.array().cast("array<string>")), lambda x: x == a)).cast("string"))

    def about(name: str) -> Column:
        if name == "enrichedAt" and name in said:
            return shown_date(e[name], said[name])
        if name == "confidence" and name in said:
            return e[name]["overall"] if said[name].startswith("struct") else e[name].cast("string")
        if name in ("actionsSummary", "fieldsEnrichedCount", "fieldsCleanedCount") and "actions" in said:
            return shown_actions(e["actions"]) if name == "actionsSummary" else counted("ENRICHED" if "Enriched" in name else "CLEANED")
        return no_text()

    def text(name: str) -> Column:
        if name in ENRICHMENT_COLUMNS:
            return about(name)
        if name not in kinds:
            return no_text()
        c, kind = kinds[name]
        return shown_phone(present(c.cast("string"))) if name == "phone" else shown_date(c, kind) if kind.startswith("timestamp") or kind == "date" else shown_value(c, kind)

    own = [F.col("row_id")] if "row_id" in df.columns and "rowId" not in names else []
    return df.select(*own, *(F.coalesce(text(n), F.lit("")).alias(n) for n in names))


def export_table(df: DataFrame, columns: list[str] | None = None, core: bool = False, every: bool = False, enrichment: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """The chosen columns as text under their headers."""
    names = select_export_columns(df, columns, core, every, enrichment, exclude)
    return format_columns(df, names).select(*(F.col(n).alias(header(n)) for n in names))
