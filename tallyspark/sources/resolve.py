"""Resolution of input columns from header names (and, where a header says nothing, from a few values)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark import constants as K


def normalise_header(name: str) -> str:
    return re.sub(r"\s+", " ", str(name).lstrip("\ufeff")).strip().lower()


def _first(columns: list[str], test) -> str | None:
    return next((c for c in columns if test(normalise_header(c))), None)


def pick_column(columns: list[str], candidates: list[str]) -> str | None:
    """Exact match over the candidates in order, then the first candidate contained in a header."""
    for exact in (True, False):
        for candidate in candidates:
            hit = _first(columns, lambda h: h == candidate if exact else candidate in h)
            if hit:
                return hit
    return None


def ledger_columns(columns: list[str]) -> dict[str, str | None]:
    """Ledger columns in three passes: exact, contained, keyword; `unnamed` is never a name."""
    found: dict[str, str | None] = {}
    for field, names in K.GL_HEADERS.items():

        def allowed(h: str, field: str = field) -> bool:
            return field != "name" or "unnamed" not in h

        found[field] = (
            _first(columns, lambda h: h in names)
            or _first(columns, lambda h: allowed(h) and any(n in h for n in names))
            or _first(columns, lambda h: allowed(h) and any(k in h for k in K.GL_KEYWORDS[field]))
        )
    return found


def text_like_column(df: DataFrame, columns: list[str]) -> str | None:
    """First column of which more than 70 % of the values are text and not numbers; one pass over all columns."""
    if not columns:
        return None
    counts = []
    for n, c in enumerate(columns):
        v = F.col(f"`{c}`").cast("string")
        is_text = ~F.regexp_replace(v, "[.,-]", "").rlike(r"^\d+$")
        counts += [F.count(v).alias(f"n{n}"), F.count_if(is_text).alias(f"t{n}")]
    row = df.agg(*counts).first()
    return next((c for n, c in enumerate(columns) if row[f"t{n}"] > row[f"n{n}"] * 0.7), None)


def column_with_data(df: DataFrame, columns: list[str]) -> str:
    """First column that holds any value; the first one when none does."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{n}") for n, c in enumerate(columns)]).first()
    return next((c for n, c in enumerate(columns) if counts[n] > 0), columns[0])


def resolve_ledger(df: DataFrame) -> dict[str, str | None]:
    """Ledger mapping with memo fallback and choice among several category columns."""
    found = ledger_columns(df.columns)
    if not found["memo"]:
        taken = {c for c in found.values() if c}
        found["memo"] = text_like_column(df, [c for c in df.columns if c not in taken])
        if not found["memo"]:
            raise ValueError(f"no description column among {df.columns}")
    others = {found[f] for f in ("date", "name", "memo", "debit", "credit", "amount")}
    free = [c for c in df.columns if c not in others]
    several = [c for c in free if any(n in normalise_header(c) for n in K.GL_HEADERS["split"])]
    if len(several) > 1:
        found["split"] = column_with_data(df, several)
    else:
        # with no free category column, a split that is also another field stays as found by its header
        found["split"] = several[0] if several else found["split"]
    return found


def _has(*words: str):
    return lambda h: all(w in h for w in words)


def bank_columns(columns: list[str]) -> dict[str, str | None]:
    """Bank CSV columns; a posting date comes before any other date, `type` must be the whole header."""
    return {
        "date": _first(columns, _has("posting", "date")) or _first(columns, _has("date")),
        "description": _first(columns, _has("description")),
        "type": _first(columns, lambda h: h == "type"),
        "amount": _first(columns, _has("amount")),
        "debit": _first(columns, _has("debit")),
        "credit": _first(columns, _has("credit")),
        "account_number": _first(columns, _has("account", "number")),
    }


def sheet_columns(columns: list[str]) -> dict[str, str | None]:
    """Bank spreadsheet columns including the cheque number."""
    found = {c: bank_columns(columns)[c] for c in ("description", "amount", "account_number")}
    found["date"] = _first(columns, _has("date"))
    found["check_number"] = _first(columns, lambda h: ("cheque" in h or "check" in h) and "no" in h)
    return found


def tabular_columns(columns: list[str]) -> dict[str, str | None]:
    return {field: pick_column(columns, names) for field, names in K.TABULAR_HEADERS.items()}


def register_columns(columns: list[str]) -> dict[str, str | None]:
    """Check register columns by exact header; number and payee are required."""
    found = {field: _first(columns, lambda h: h in names) for field, names in K.REGISTER_HEADERS.items()}
    if not found["check_number"] or not found["payee_name"]:
        raise ValueError(f"check register without check number or payee column: {columns}")
    return found


def inspect_register(df: DataFrame, rows: int = 15) -> tuple[dict[str, str | None], list[str], DataFrame]:
    """Detected columns, missing ones and a preview of a register."""
    names = [" ".join(normalise_header(c).replace("_", " ").split()) for c in df.columns]
    found = {f: pick_column(names, c) for f, c in K.REGISTER_INSPECTION_HEADERS.items()}
    return found, [f for f, c in found.items() if c is None], df.limit(rows)


def range_column(columns: list[str]) -> str | None:
    return _first(columns, lambda h: h in K.GL_RANGE_HEADERS) or _first(columns, lambda h: "date" in h)


def select_resolved(df: DataFrame, mapping: dict[str, str | None], keep: tuple[str, ...] = ()) -> DataFrame:
    """The resolved columns under their field names."""
    return df.select(*keep, *[F.col(f"`{c}`").alias(field) for field, c in mapping.items() if c])
