"""The steps of Porter's stemmer as DuckDB SQL, to hold the stemmer against."""

from __future__ import annotations

from lexmill.functions.stem import DOUBLE, FOURTH, MEASURE_0, MEASURE_1, PLURALS, SECOND, SHORT, THIRD, VOWEL


def _like(x: str, *patterns: str) -> str:
    return "(" + " AND ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _suffixes(rules: list[tuple[str, str, list[str]]]) -> str:
    cases = "".join(f" WHEN ends_with(w, '{s}') THEN CASE WHEN {_like(f'left(w, length(w) - {len(s)})', *on)} THEN left(w, length(w) - {len(s)}) || '{by}' ELSE w END" for s, by, on in sorted(rules, key=lambda r: -len(r[0])))
    return f"CASE WHEN NOT {_like('w', '^[a-zY]{3,}$')} THEN w{cases} ELSE w END"


def steps() -> list[str]:
    rest = bare = "left(w, length(w) - 1)"
    return [
        f"CASE WHEN {_like('w', '^[a-z]{3,}$')} THEN regexp_replace(w, '([^aeiou])y', '\\1Y', 'g') ELSE w END",
        _suffixes([(s, by, [""]) for s, by in PLURALS]),
        _suffixes([("eed", "ee", [MEASURE_0]), ("ed", "+", [VOWEL]), ("ing", "+", [VOWEL])]),
        f"""CASE WHEN NOT ends_with(w, '+') THEN w WHEN {_like(rest, '(at|bl|iz)$')} THEN {rest} || 'e' WHEN {_like(rest, DOUBLE)} THEN left(w, length(w) - 2)
  WHEN {_like(rest, MEASURE_0, SHORT)} AND NOT {_like(rest, MEASURE_1)} THEN {rest} || 'e' ELSE {rest} END""",
        _suffixes([(s, "i", [VOWEL]) for s in "yY"]),
        _suffixes([(s, by, [MEASURE_0]) for s, by in SECOND]),
        _suffixes([(s, by, [MEASURE_0]) for s, by in THIRD]),
        _suffixes([(s, "", [MEASURE_1, "[st]$"] if s == "ion" else [MEASURE_1]) for s in FOURTH]),
        f"CASE WHEN ends_with(w, 'e') AND {_like('w', '^[a-zY]{3,}$')} AND ({_like(bare, MEASURE_1)} OR {_like(bare, MEASURE_0)} AND NOT {_like(bare, SHORT)}) THEN {bare} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_like('w', MEASURE_1, '^[a-zY]+$')} THEN {bare} ELSE w END",
        f"CASE WHEN {_like('w', '^[a-zY]+$')} THEN lower(w) ELSE w END",
    ]


def with_stem(table: str, term: str = "term", name: str = "stem") -> str:
    """A query that adds the stem to ``table``."""
    out = f"(SELECT *, {term} AS w FROM {table})"
    for step in steps():
        out = f"(SELECT * REPLACE ({step} AS w) FROM {out})"
    return f"(SELECT * RENAME (w AS {name}) FROM {out})"
