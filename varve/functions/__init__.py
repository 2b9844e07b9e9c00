from varve.functions.money import add, amounts, mean, total
from varve.functions.rules import (
    clamp,
    clamp_text,
    days_since,
    ladder,
    month_of,
    order_status,
    present,
    row_fingerprint,
    safe_date,
    whole_number,
)

__all__ = [
    "add",
    "amounts",
    "clamp",
    "clamp_text",
    "days_since",
    "ladder",
    "mean",
    "month_of",
    "order_status",
    "present",
    "row_fingerprint",
    "safe_date",
    "total",
    "whole_number",
]
