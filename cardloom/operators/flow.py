"""The whole run over contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_name, clean_plain, extract_email, extract_phone
from .dedup import dedup_contacts
from .enrich import FIELDS, enrich, enrichment_metadata
from .postclean import post_clean, post_clean_stats
from .stats import cleaning_report, contact_stats

CLEANERS = {"name": clean_name, "email": extract_email, "phone": extract_phone, "title": clean_plain, "location": clean_plain}


def contact_pipeline(contacts: DataFrame, profiles: DataFrame | None = None, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Dedup (D1), enrich (J1), post_clean (C28) and clean (C17), each unless it is skipped (enrich also without profiles), with the
    reports of what ran: contacts, and stats; enrichment; post_clean_stats; cleaning. Nothing runs until a table is used."""
    unknown = set(skip) - {"dedup", "enrich", "post_clean", "clean"}
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    d = contacts if "dedup" in skip else dedup_contacts(contacts).drop("first_row")
    out = {"stats": contact_stats(d, contacts)}
    if profiles is not None and "enrich" not in skip:
        e = enrich(d, profiles)
        out["enrichment"] = enrichment_metadata(e)
        d = e.select(*(F.col(f"merged_{c}.value").alias(c) if c in FIELDS else F.col(c) for c in d.columns))
    if "post_clean" not in skip:
        d = post_clean(d)
        out["post_clean_stats"] = post_clean_stats(d)
    if "clean" not in skip:
        c = d.withColumns({f"clean_{k}": f(F.col(k)) for k, f in CLEANERS.items()})
        out["cleaning"] = cleaning_report(c)
        d = c.select(*(F.col(f"clean_{k}.value").alias(k) if k in CLEANERS else F.col(k) for k in d.columns))
    return out | {"contacts": d}
