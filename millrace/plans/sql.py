"""Fragments shared by the SQL texts."""

NET = "cast(l_extendedprice as decimal(12,2)) * (1 - cast(l_discount as decimal(4,2)))"


def in_year(column: str, year: int) -> str:
    return f"{column} >= timestamp '{year}-01-01' and {column} < timestamp '{year + 1}-01-01'"
