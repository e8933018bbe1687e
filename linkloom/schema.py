"""Canonical entity schemas: missing text is '' and missing time is 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "tournaments": "id string, name string, sport string, category_name string, source string",
    "events": "id string, tournament_id string, start_unix bigint, home_id string, home_name string, away_id string, away_name string, status_code int, source string",
    "teams": "id string, name string, source string",
    "players": "id string, name string, full_name string, birthday string, nationality string, team_id string, source string",
}


def fields(entity: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in SCHEMAS[entity].split(", ")]


def canonical(df: DataFrame, entity: str) -> DataFrame:
    """``df`` with exactly the entity's columns: cast, missing ones added, nulls as '' or 0."""
    out = []
    for name, kind in fields(entity):
        c = F.col(name) if name in df.columns else F.lit(None)
        out.append(F.coalesce(c.cast(kind), F.lit("" if kind == "string" else 0).cast(kind)).alias(name))
    return df.select(*out)


def assert_schema(df: DataFrame, entity: str) -> DataFrame:
    """Fail early on a missing column or another type."""
    have = dict(df.dtypes)
    wrong = [f"{n}: {have.get(n, 'missing')} for {k}" for n, k in fields(entity) if have.get(n) != k]
    if wrong:
        raise TypeError(f"{entity}: " + "; ".join(wrong))
    return df
