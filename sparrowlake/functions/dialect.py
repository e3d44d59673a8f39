"""Function names that Spark does not know, rewritten to those it does, outside quotes and comments."""

from __future__ import annotations

import re

from sparrowlake.sqlprep import outside_quotes

#: Name here, name in Spark; same arguments in the same order.
RENAMED = {
    "approx_distinct": "approx_count_distinct",
    "approx_percentile_cont": "approx_percentile",
    "array_concat": "concat",
    "array_element": "element_at",
    "array_extract": "element_at",
    "array_has": "array_contains",
    "array_length": "size",
    "array_push_back": "array_append",
    "array_to_string": "array_join",
    "ends_with": "endswith",
    "list_append": "array_append",
    "list_contains": "array_contains",
    "list_distinct": "array_distinct",
    "list_element": "element_at",
    "list_length": "size",
    "list_sort": "array_sort",
    "list_to_string": "array_join",
    "make_array": "array",
    "map_extract": "element_at",
    "starts_with": "startswith",
    "strpos": "instr",
    "substr_index": "substring_index",
    "unnest": "explode",
}
#: Names with another shape: the arguments are {0}, {1}, ...
SHAPED = {
    "approx_median": "approx_percentile({0}, 0.5)",
    "sha224": "sha2({0}, 224)",
    "sha256": "sha2({0}, 256)",
    "sha384": "sha2({0}, 384)",
    "sha512": "sha2({0}, 512)",
    "array_slice": "slice({0}, {1}, {2} - {1} + 1)",
    "date_bin": "timestamp_micros(unix_micros(CAST({1} AS TIMESTAMP)) - pmod(unix_micros(CAST({1} AS TIMESTAMP)), CAST(extract(SECOND FROM {0}) * 1000000 + extract(MINUTE FROM {0}) * 60000000 + extract(HOUR FROM {0}) * 3600000000 + extract(DAY FROM {0}) * 86400000000 AS BIGINT)))",
}
#: Type names of the columnar format and what they are in SQL; Decimal128(p, s) and Timestamp(unit, zone) aside.
ARROW_TYPES = {
    "int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "float32": "FLOAT", "float64": "DOUBLE",
    "boolean": "BOOLEAN", "utf8": "STRING", "largeutf8": "STRING", "utf8view": "STRING", "binary": "BINARY", "date32": "DATE", "date64": "DATE",
}
#: The fields of strftime that date_format knows.
STRFTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "j": "DDD", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%"}


def _text(literal: str) -> str | None:
    return literal[1:-1].replace("''", "'") if len(literal) > 1 and literal[0] == literal[-1] == "'" else None


def _regexp_match(text: str, pattern: str) -> str | None:
    """The groups of the first match, or the whole of it where the pattern has none; null without a match."""
    plain = _text(pattern)
    try:
        groups = re.compile(plain.replace("\\\\", "\\")).groups if plain is not None else 0
    except re.error:
        groups = 0
    parts = ", ".join(f"regexp_extract({text}, {pattern}, {i})" for i in (range(1, groups + 1) if groups else [0]))
    return f"CASE WHEN {text} RLIKE {pattern} THEN array({parts}) END"


def _arrow_cast(value: str, kind: str) -> str | None:
    name = (_text(kind) or "").replace(" ", "").lower()
    if m := re.fullmatch(r"decimal(?:128|256)\((\d+),(\d+)\)", name):
        return f"CAST({value} AS DECIMAL({m[1]}, {m[2]}))"
    if m := re.fullmatch(r"timestamp\(\w+,(.+)\)", name):
        return f"CAST({value} AS {'TIMESTAMP_NTZ' if m[1] == 'none' else 'TIMESTAMP'})"
    return f"CAST({value} AS {ARROW_TYPES[name]})" if name in ARROW_TYPES else None


def _digest(value: str, method: str) -> str | None:
    name = (_text(method) or "").lower()
    bits = name.removeprefix("sha")
    return f"unhex(md5({value}))" if name == "md5" else f"unhex(sha2({value}, {bits}))" if bits in ("224", "256", "384", "512") else None


def _to_char(value: str, pattern: str) -> str | None:
    """Patterns with % are strftime's; others are left alone."""
    plain = _text(pattern)
    if plain is None or "%" not in plain:
        return None
    quoted = lambda x: re.sub(r"[A-Za-z]+", lambda m: f"\\'{m[0]}\\'", x)
    pieces = re.split(r"%(.)", plain)
    if any(f not in STRFTIME for f in pieces[1::2]):
        return None
    return f"date_format({value}, '{''.join(STRFTIME[x] if i % 2 else quoted(x) for i, x in enumerate(pieces))}')"


def _from_unixtime(seconds: str) -> str | None:
    return f"(TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds}))"


#: Names whose shape depends on their arguments; None leaves the call as it is.
BUILT = {"regexp_match": _regexp_match, "arrow_cast": _arrow_cast, "digest": _digest, "to_char": _to_char, "from_unixtime": _from_unixtime}
_NAME = re.compile(r"(?<![\w.`])(" + "|".join(sorted([*RENAMED, *SHAPED, *BUILT], key=len, reverse=True)) + r")\s*\(", re.IGNORECASE)


def _closing(text: str, quoted: list[bool], start: int) -> tuple[int, list[int]]:
    """Where the parenthesis opened before ``start`` closes, and the commas of its level."""
    depth, commas = 1, []
    for i in range(start, len(text)):
        if quoted[i]:
            continue
        if text[i] in "([":
            depth += 1
        elif text[i] in ")]":
            depth -= 1
            if not depth:
                return i, commas
        elif text[i] == "," and depth == 1:
            commas.append(i)
    raise ValueError("unbalanced parentheses")


def translate(sql: str) -> str:
    """The statement with Spark's function names; anything unbalanced is left to Spark's parser."""
    done = 0  # calls before this place are left as they are
    while True:
        pieces = outside_quotes(sql)
        quoted = [q for q, x in pieces for _ in x]
        found = next((m for m in _NAME.finditer(sql, done) if not quoted[m.start()]), None)
        if found is None:
            return sql
        name = found[1].lower()
        if name in RENAMED:
            sql = sql[: found.start()] + RENAMED[name] + "(" + sql[found.end() :]
            continue
        try:
            end, commas = _closing(sql, quoted, found.end())
        except ValueError:
            return sql
        cuts = [found.end() - 1, *commas, end]
        args = [sql[a + 1 : b].strip() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if name in BUILT:
            try:
                built = BUILT[name](*args)
            except TypeError:  # another number of arguments
                built = None
            if built is None:
                done = found.end()
            else:
                sql = sql[: found.start()] + built + sql[end + 1 :]
            continue
        try:
            sql = sql[: found.start()] + SHAPED[name].format(*args) + sql[end + 1 :]
        except IndexError:
            return sql
