"""DuckDB spellings of the text functions, for the SQL beside each query."""

from __future__ import annotations

from ..functions.text import LEGAL_SUFFIXES


def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def match(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[_/|]+', ' ', 'g'), '[^a-z0-9+&.-]+', ' ', 'g'))"


def fingerprint(x: str) -> str:
    head = rf"regexp_extract(replace(regexp_replace(lower({clean(x)}), '\([^)]*\)', ' ', 'g'), '&', ' and '), '^[^,;]*')"
    spaced = f"' ' || array_to_string(regexp_extract_all({head}, '[a-z0-9]+'), '  ') || ' '"
    merged = rf"regexp_replace(replace(regexp_replace({spaced}, ' ([a-z]) ', '<\1>', 'g'), '><', ''), '[<> ]+', ' ', 'g')"
    return f"trim(regexp_replace(' ' || trim({merged}), '( ({'|'.join(LEGAL_SUFFIXES)}))+$', ''))"


def summary(x: str, words: int) -> str:
    parts = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"
    return f"CASE WHEN len({parts}) <= {words} THEN {x} ELSE regexp_replace(array_to_string({parts}[1:{words}], ' '), '[.,;:]+$', '') || '...' END"


def slug(x: str, mark: str = "_") -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '{mark}', 'g'), '^{mark}+|{mark}+$', '', 'g')"


#: Company names with the variants that the key has to see through.
def variants(name: str, key: str) -> str:
    return f"CASE {key} % 6 WHEN 0 THEN {name} || ', Inc.' WHEN 1 THEN '  ' || {name} || ' LLC' WHEN 2 THEN 'U S A ' || {name} WHEN 3 THEN {name} || ' (West) Co Ltd' WHEN 4 THEN 'A&B ' || {name} ELSE 'Inc' END"
