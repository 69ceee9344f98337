"""Payee name from a description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions.text import strip


def _usable(c: Column) -> Column:
    return F.when((F.length(c) > 2) & (F.length(c) < 100), c)


def _is_number(w: Column) -> Column:
    return F.regexp_replace(w, "[.,]", "").rlike(r"^\d+$")


def _is_code(w: Column) -> Column:
    digits = F.length(F.regexp_replace(w, r"\D", ""))
    return _is_number(w) | ((F.length(w) >= 6) & (digits * 10 >= F.length(w) * 7))


def _is_abbreviation(w: Column) -> Column:
    return (F.length(w) <= 3) & (w == F.upper(w)) & (w != F.lower(w))


def _is_capitalised(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def _collect_name(words: Column, skip, stop) -> Column:
    """Up to three capitalised words; `skip` words are passed over, `stop` words end the search,
    and so does a word in lower case once a name has begun."""
    start = F.struct(F.array().cast("array<string>").alias("name"), F.lit(False).alias("done"))

    def step(acc: Column, w: Column) -> Column:
        extended = F.concat(acc["name"], F.array(w))
        taken = F.struct(extended.alias("name"), (F.size(extended) >= 3).alias("done"))
        ended = F.struct(acc["name"].alias("name"), F.lit(True).alias("done"))
        kept = F.struct(acc["name"].alias("name"), acc["done"].alias("done"))
        return (
            F.when(acc["done"], kept)
            .when(stop(w), ended)
            .when(skip(w), kept)
            .when(_is_capitalised(w), taken)
            .when(F.size(acc["name"]) > 0, ended)
            .otherwise(kept)
        )

    return F.aggregate(words, start, step, lambda acc: F.array_join(acc["name"], " "))


def _person_at_end(words: Column, count: int) -> Column:
    tail = F.when(F.size(words) >= count, F.slice(words, -count, count))
    text = F.upper(F.array_join(tail, " "))
    client_like = text.rlike("|".join(m.replace(".", r"\.") for m in K.PAYEE_CLIENT_MARKS))
    personal = F.forall(
        tail,
        lambda w: ~F.upper(w).isin(K.PAYEE_GENERIC_TERMS) & ~_is_abbreviation(w) & ~w.rlike(r"\d") & _is_capitalised(w),
    )
    return F.when(personal & ~client_like, F.array_join(tail, " "))


def payee_from_description(description: Column) -> Column:
    """Payee name, or empty text: explicit phrases, name before codes, name at start, person at end."""
    d = strip(F.coalesce(description, F.lit("")))
    words = F.split(d, r"\s+")

    def generic(w: Column) -> Column:
        return F.upper(w).isin(K.PAYEE_GENERIC_TERMS) | _is_abbreviation(w)

    codes = F.transform(words, _is_code)
    code_at = F.array_position(codes, True)  # 1-based, 0 when absent
    middle = F.when(code_at > 4, F.slice(words, F.lit(4), (code_at - 4).cast("int")))
    in_middle = _collect_name(middle, lambda w: generic(w) | w.rlike(r"\d"), lambda w: F.lit(False))
    at_start = _collect_name(
        F.slice(words, 1, 5),
        generic,
        # a word with digits ends the search, unless it counts as an abbreviation and is passed over
        lambda w: F.upper(w).isin(K.PAYEE_STOP_TERMS) | (~generic(w) & w.rlike(r"\d")),
    )
    candidates = [_usable(strip(F.regexp_extract(d, p, 1))) for p in K.PAYEE_PHRASES]
    candidates += [_usable(in_middle), _usable(at_start)]
    candidates += [_usable(_person_at_end(words, n)) for n in (2, 3, 4)]
    return F.coalesce(*candidates, F.lit(""))
