"""Finding columns by ordered candidate names. Works on column names only; no data is read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from rollbook import fixed_values as fv


def _names(df: DataFrame | Sequence[str]) -> list[str]:
    return list(df.columns) if isinstance(df, DataFrame) else list(df)


def _underscored(name: str) -> str:
    return name.lower().replace(" ", "_")


def resolve(df: DataFrame | Sequence[str], candidates: Sequence[str], loose: bool = False) -> str | None:
    """The first candidate that names a column: exactly, ignoring case, or (loose) with blanks read as underscores."""
    names = _names(df)
    by_lower = {n.lower(): n for n in names}
    by_underscored = {_underscored(n): n for n in names} if loose else {}
    for wanted in candidates:
        found = wanted if wanted in names else by_lower.get(wanted.lower()) or by_underscored.get(_underscored(wanted))
        if found:
            return found
    return None


def resolve_or_position(
    df: DataFrame | Sequence[str], candidates: Sequence[str], position: int, loose: bool = True
) -> str | None:
    """Like `resolve`, falling back to the column at a position when there is one."""
    names = _names(df)
    return resolve(names, candidates, loose) or (names[position] if position < len(names) else None)


def resolve_roles(
    df: DataFrame | Sequence[str],
    roles: Mapping[str, Sequence[str]] = fv.ROSTER_ROLES,
    overrides: Mapping[str, str] | None = None,
) -> dict[str, str | None]:
    """Role to column. An override that names no column is an error; a role that is not found maps to None."""
    names = _names(df)
    by_lower = {n.lower(): n for n in names}
    found: dict[str, str | None] = {}
    for role, candidates in roles.items():
        explicit = (overrides or {}).get(role)
        if explicit and explicit not in names:
            raise ValueError(f"column {explicit!r} for {role!r} not found; there are {names}")
        found[role] = explicit or next((by_lower[c] for c in candidates if c in by_lower), None)
    return found


def address_sets(df: DataFrame | Sequence[str]) -> list[tuple[str, str | None, str | None, str | None]]:
    """The (address, city, zip, state) column sets present: the coalesced gold columns, else the raw ones."""
    names = _names(df)
    styles = fv.GOLD_ADDRESS_SETS if resolve(names, ["_addr1"]) else fv.RAW_ADDRESS_SETS
    sets: list[tuple[str, str | None, str | None, str | None]] = []
    for addr, city, zip_, state in styles:
        column = resolve(names, addr)
        if column and all(column != s[0] for s in sets):
            sets.append((column, resolve(names, city), resolve(names, zip_), resolve(names, state)))
    return sets


def numbered_address_sets(df: DataFrame | Sequence[str]) -> list[tuple[str, str | None, str | None, str | None]]:
    """address_1, city_1, zip_1, address_2 ... as long as the numbers run on."""
    names = _names(df)
    sets: list[tuple[str, str | None, str | None, str | None]] = []
    while True:
        i = len(sets) + 1
        column = resolve(names, [f"address_{i}", f"primary_address_{i}"], loose=True)
        if not column:
            return sets
        sets.append((column, resolve(names, [f"city_{i}"]), resolve(names, [f"zip_{i}"]), None))
