"""Lineage of governed columns: which day a value is of, how its price was adjusted, when it was known."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import ContractError

#: Fixed form of a factor version.
VERSION = r"\Araw-times-same-day-adj-v1:[0-9a-f]{64}\z"


@dataclass(frozen=True)
class Audit:
    """A governed field's audit columns; None where it has none. horizon: sessions between the row's date and the value's."""

    source_date: str
    version: str | None = None
    as_of: str | None = None
    basis: str | None = None
    horizon: int = 0


def load_manifest(path: str) -> dict[str, Audit]:
    with open(path) as f:
        raw = json.load(f)
    if raw.get("schema_version") != 1 or not isinstance(raw.get("fields"), dict):
        raise ContractError("a manifest has schema_version 1 and fields")
    out = {}
    for name, x in raw["fields"].items():
        if not isinstance(x.get("horizon"), int) or x["horizon"] < 0:
            raise ContractError(f"{name}: horizon must be a whole number")
        out[name] = Audit(x["source_date"], x.get("adj_factor_version"), x.get("as_of_time"), x.get("price_basis"), x["horizon"])
    return out


def violations(df: DataFrame, audit: Audit, cal: DataFrame, date: str = "trade_date", train_end: str | None = None) -> DataFrame:
    """df with ``violation``: the first rule a row breaks, NULL if none. cal is (t, trade_date), fixed in size.

    Rules in order: date (the row's date is no session), source (missing or malformed source date), calendar (the source
    date is not the session ``horizon`` after the row's), basis, version, as_of (missing, of another day, or after the
    close), train_end (the source date lies beyond).
    """
    days = F.broadcast(cal.select(F.col("trade_date").alias("_d"), F.col("t").alias("_t")))
    target = F.broadcast(cal.select(F.col("trade_date").alias("_due"), (F.col("t") - audit.horizon).alias("_t")))
    plain = lambda c: F.translate(F.col(c), "-", "")
    x = df.withColumn("_d", plain(date)).join(days, "_d", "left").join(target, "_t", "left")
    src = plain(audit.source_date)
    rules: list[tuple[str, Column]] = [
        ("date", F.col("_t").isNull()),
        ("source", F.col(audit.source_date).isNull() | ~F.col(audit.source_date).rlike(r"\A(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})\z")),
        ("calendar", F.col("_due").isNull() | (src != F.col("_due"))),
    ]
    if audit.basis:
        rules.append(("basis", F.coalesce(F.col(audit.basis) != "hfq", F.lit(True))))
    if audit.version:
        rules.append(("version", ~F.coalesce(F.col(audit.version).rlike(VERSION), F.lit(False))))
    if audit.as_of:
        at = F.col(audit.as_of)
        rules.append(("as_of", F.coalesce(~at.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+\+08:00\z") | (F.translate(F.substring(at, 1, 10), "-", "") != src) | (F.substring(at, 12, 8) > "15:00:00"), F.lit(True))))
    if train_end:
        rules.append(("train_end", src > train_end))
    v = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        v = F.when(broken, name).otherwise(v)
    return x.withColumn("violation", v).select(*[F.col(f"`{c}`") for c in df.columns], "violation")


def require_clean(df: DataFrame, audit: Audit, cal: DataFrame, **kw) -> DataFrame:
    """df, if no row breaks a rule."""
    bad = violations(df, audit, cal, **kw).where("violation is not null").limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0]['violation']} rule broken: {bad[0].asDict()}")
    return df


def governed_scan(df: DataFrame, manifest: dict[str, Audit], cal: DataFrame, fields: list[str], date: str = "trade_date", code: str = "stock_code", train_end: str | None = None, one_version: bool = False) -> DataFrame:
    """(t, trade_date, code, slot, fields) of a table all of whose rows keep their lineage: validated, projected, packed.

    Every field must be in the manifest. Rows of a date are numbered by code. one_version: a version column may hold one only.
    """
    from ..common import norm_code, plain_date
    from ..operators.relational import slots

    unknown = [c for c in fields if c not in manifest]
    if unknown:
        raise ContractError(f"the manifest doesn't know {unknown}")
    for audit in dict.fromkeys(manifest[c] for c in fields):
        require_clean(df, audit, cal, date=date, train_end=train_end)
        if one_version and audit.version and len(df.select(audit.version).distinct().limit(2).collect()) > 1:
            raise ContractError(f"{audit.version} holds several versions")
    rows = df.select(plain_date(date).alias("trade_date"), norm_code(code).alias("code"), *fields)
    return slots(rows.join(F.broadcast(cal.select("t", "trade_date")), "trade_date")).select("t", "trade_date", "code", "slot", *fields)
