"""Device, address and validity of web events; bank names in statement text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import constants as K
from tallyspark.functions.text import contains_any, strip


def device_info(user_agent: Column) -> Column:
    """Struct of device, browser and system; null parts for an empty agent."""
    ua = F.lower(user_agent)
    mobile = contains_any(ua, ["mobile", "android", "iphone", "ipad"])
    tablet = contains_any(ua, ["tablet", "ipad"])
    edge = contains_any(ua, ["edge", "edg"])
    device = F.when(mobile & tablet, "Tablet").when(mobile, "Mobile").otherwise("Desktop")
    browser = (
        F.when(ua.contains("chrome") & ~edge, "Chrome")
        .when(ua.contains("firefox"), "Firefox")
        .when(ua.contains("safari") & ~ua.contains("chrome"), "Safari")
        .when(edge, "Edge")
        .otherwise("Other")
    )
    system = (
        F.when(ua.contains("windows"), "Windows")
        .when(ua.contains("mac"), "macOS")
        .when(ua.contains("linux"), "Linux")
        .when(ua.contains("android"), "Android")
        .when(contains_any(ua, ["ios", "iphone", "ipad"]), "iOS")
        .otherwise("Other")
    )
    known = F.coalesce(ua, F.lit("")) != ""
    return F.struct(
        F.when(known, device).alias("device"),
        F.when(known, browser).alias("browser"),
        F.when(known, system).alias("os"),
    )


def client_address(forwarded: Column, real_ip: Column, host: Column) -> Column:
    first = strip(F.split(F.nullif(forwarded, F.lit("")), ",")[0])
    return F.coalesce(first, F.nullif(real_ip, F.lit("")), host)


def is_valid_event(event_type: Column, status: Column) -> Column:
    return F.coalesce(event_type.isin(K.VALID_EVENT_TYPES) & status.isin(K.VALID_STATUSES), F.lit(False))


def bank_from_file_name(name: Column) -> Column:
    n = F.lower(name)
    return (
        F.when(contains_any(n, ["wells", "wf"]), "Wells Fargo")
        .when(n.contains("chase"), "Chase Bank")
        .when(contains_any(n, ["boa", "bofa", "bank of america"]), "Bank of America")
        .otherwise("Unknown")
    )


def bank_from_text(text: Column) -> Column:
    """Bank named in a text, in fixed test order."""
    t = F.replace(F.upper(text), F.lit("\u00a0"), F.lit(" "))
    return F.coalesce(
        F.when(t.contains("WELLS FARGO"), "Wells Fargo")
        .when(t.contains("BMO"), "BMO")
        .when(contains_any(t, ["JPMORGAN CHASE BANK", "CHASE BANK"]), "Chase Bank")
        .when(t.contains("BANK OF AMERICA"), "Bank of America")
        .when(t.contains("CHASE") & t.contains("CREDIT CARD STATEMENT"), "Chase Credit Card")
        .when(t.contains("CREDIT CARD STATEMENT"), "Credit Card"),
        F.lit("Unknown"),
    )


def is_bank_statement(text: Column) -> Column:
    t = F.lower(text)
    hits = sum((F.when(t.contains(k), 1).otherwise(0) for k in K.STATEMENT_KEYWORDS), F.lit(0))
    return hits >= K.STATEMENT_MIN_KEYWORDS
