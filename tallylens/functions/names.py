"""Rules on column names; they look at the schema only, never at rows."""

from __future__ import annotations

import re

# Name patterns that decide how a column is treated.
ID_SUFFIXES = ("_id", "id", "_key", "_uuid", "_index")
ID_NAMES = ("id", "index", "uuid", "key", "idx")
GEO_PARTS = ("lat", "lng", "lon", "x_coord", "y_coord", "coordinates", "geoloc")
POSTAL_PARTS = ("zip", "postal", "pincode", "postcode")
TIMESTAMP_PARTS = ("created_at", "updated_at", "timestamp", "datetime", "event_time")
DATE_PARTS = ("date", "time", "created", "at")
CLEAN_DATE_PARTS = ("date", "time", "created", "updated", "at")
CURRENCY_PARTS = ("price", "amount", "cost", "value", "revenue", "salary")
STATUS_PARTS = ("status", "type", "category", "payment", "risk", "method")
CHART_SKIP_PARTS = (
    "_id", "_key", "_uuid", "_index", "lat", "lng", "lon", "zip", "postal",
    "timestamp", "datetime", "created_at", "updated_at",
)
STRICT_ID_PARTS = ("_index", "uuid", "_key", "hash")
CATEGORY_PARTS = ("category", "type", "kind", "group", "segment")
GEO_TAG_PARTS = ("city", "country", "region", "state", "zip")
CHART_DATE_PARTS = ("date", "time", "month", "year")

# Columns that mark a business domain, in order of preference.
DOMAIN_SIGNATURES = {
    "ecommerce": ("order_id", "product_id", "customer_id", "unit_price", "total_amount", "quantity"),
    "finance": ("transaction_id", "account_id", "debit", "credit", "balance", "instrument"),
    "saas": ("user_id", "subscription_id", "mrr", "churn", "plan", "trial"),
    "hr": ("employee_id", "department", "salary", "hire_date", "performance"),
}


def has_part(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name for p in parts)


def not_analytic(name: str) -> bool:
    """True for ids, coordinates, postal codes and raw timestamps."""
    low = name.lower()
    return (
        low.endswith(ID_SUFFIXES)
        or low in ID_NAMES
        or has_part(low, GEO_PARTS + POSTAL_PARTS + TIMESTAMP_PARTS)
    )


def not_useful(name: str) -> bool:
    """The stricter rule: also names that hold a mark of an id anywhere."""
    return not_analytic(name) or has_part(name.lower(), STRICT_ID_PARTS)


def skip_in_chart(name: str) -> bool:
    """True for columns that no chart should show; a bare ``id`` counts as suffix only."""
    low = name.lower()
    return low.endswith("id") or has_part(low, CHART_SKIP_PARTS)


def normalised(names: list[str]) -> list[str]:
    """Trimmed, lower-case names with white space as underscores."""
    out = [re.sub(r"\s+", "_", n.strip().lower()) for n in names]
    clash = sorted({n for n in out if out.count(n) > 1})
    if clash:
        raise ValueError(f"columns collide after normalising: {clash}")
    return out


def semantic_tag(name: str, is_text: bool, has_values: bool, starts_with_dollar: bool) -> str | None:
    """The first tag whose rule fits; the order of the rules matters."""
    low = name.lower()
    rules = (
        ("currency", has_part(low, CURRENCY_PARTS) or starts_with_dollar),
        ("date", has_part(low, CLEAN_DATE_PARTS)),
        ("id", low.endswith("_id") or low == "id"),
        ("status", "status" in low and is_text and has_values),
        ("category", has_part(low, CATEGORY_PARTS)),
        ("email", "email" in low),
        ("geo", has_part(low, GEO_TAG_PARTS)),
    )
    return next((tag for tag, fits in rules if fits), None)
