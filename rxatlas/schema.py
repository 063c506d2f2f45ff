"""The canonical product row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.base import nz

STORED_COLUMNS = [
    "substance", "product", "company", "country", "region", "status", "strength", "dosage_form", "pack_size",
    "atc_code", "therapeutic_category", "registration_number", "registration_date", "expiry_date",
    "manufacturer_name", "manufacturer_country", "manufacturer_source", "manufacturer_website", "smpc_url",
    "pil_url", "assessment_report_url", "product_url", "source", "source_url", "document_type", "last_checked",
]
TRANSIENT_COLUMNS = [
    "url", "route", "connector_mode", "searched_substance", "source_substance", "active_substance",
]
PRODUCT_DDL = ", ".join(f"{c} string" for c in STORED_COLUMNS)
MEDICINE_COLUMNS = ["substance", "product", "company", "country", "status", "source"]


def conform(df: DataFrame, transient: bool = False) -> DataFrame:
    """Stored columns (and the transient ones on request) in fixed order, blanks as NULL, ``ord`` kept.

    Columns outside the product row are gathered in ``extras``, so nothing a mapper adds is lost.
    """
    wanted = STORED_COLUMNS + (TRANSIENT_COLUMNS if transient else [])
    out = [
        (nz(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in wanted
    ]
    other = [c for c in df.columns if c not in {*wanted, "ord", "id", "origin", "query_id", "extras"}]
    kept = [c for c in ("id", "ord", "origin", "query_id") if c in df.columns]
    if transient and other:
        pairs = [x for c in other for x in (F.lit(c), F.col(c).cast("string"))]
        out.append(F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("extras"))
    return df.select(*kept, *out)
