"""What is done to a statement before Spark sees it."""

from __future__ import annotations

import re
from dataclasses import dataclass

SHOW = re.compile(r"^\s*show\s+tables(?:\s+(?:in|from)\s+(?P<where>[^\s;]+))?\s*;?\s*$", re.IGNORECASE)
INSERT = re.compile(r"^\s*insert\s+into\s+(?:table\s+)?(?P<name>[\w.`\"$-]+)\s*(?P<columns>\([^()]*\))?\s*(?P<rest>(?:select|values|with|from|table)\b.*)$", re.IGNORECASE | re.DOTALL)
#: `t$snapshots` and `t$manifests`, with or without a namespace, outside quotes.
META = re.compile(r"(?<![\w`$.])((?:[A-Za-z_]\w*\.)*)([A-Za-z_]\w*)\$(snapshots|manifests)\b")


def unquoted(name: str) -> str:
    return name[1:-1] if len(name) > 1 and name[0] == name[-1] and name[0] in "`\"'" else name


def parse_show_tables(sql: str) -> tuple[bool, str | None]:
    """Whether this is SHOW TABLES, and the namespace it names; a catalog before the namespace is dropped."""
    m = SHOW.match(sql)
    if not m:
        return False, None
    where = m["where"]
    return True, unquoted(re.split(r"\.(?=(?:[^`\"]*[`\"][^`\"]*[`\"])*[^`\"]*$)", where)[-1]) if where else None


def parse_insert(sql: str) -> tuple[str, list[str] | None, str] | None:
    """Table, columns and source of INSERT INTO."""
    m = INSERT.match(sql.rstrip().rstrip(";"))
    if not m:
        return None
    columns = [unquoted(c.strip()) for c in m["columns"][1:-1].split(",")] if m["columns"] else None
    return m["name"], columns, m["rest"]


def outside_quotes(sql: str) -> list[tuple[bool, str]]:
    """The statement in pieces: (whether in quotes or a comment, text)."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/)", sql, flags=re.DOTALL)
    return [(i % 2 == 1, x) for i, x in enumerate(parts)]


def renamed(sql: str, pattern: str, view: str) -> str:
    """Names that fit the pattern (with one group, a suffix) as the view's; string literals and comments stay as they are."""
    held: list[str] = []

    def hide(quoted: bool, x: str) -> str:
        if not quoted or x[:1] == "`":
            return x
        held.append(x)
        return f"\x00{len(held) - 1}\x00"

    plain = "".join(hide(quoted, x) for quoted, x in outside_quotes(sql))
    plain = re.sub(rf"(?<![\w.`]){pattern}(?![\w$`])", lambda m: f"`{view}{m[1] or ''}`", plain, flags=re.IGNORECASE)
    return re.sub(r"\x00(\d+)\x00", lambda m: held[int(m[1])], plain)


@dataclass(frozen=True)
class Definition:
    """CREATE TABLE (kind table), CREATE EXTERNAL TABLE (external) or DROP TABLE (drop); ``lenient`` with IF [NOT] EXISTS."""

    kind: str
    name: str
    lenient: bool = False
    columns: str = ""
    partition_by: tuple[tuple[str, str] | str, ...] = ()
    location: str | None = None


NAME = r"(?P<name>[\w.`$-]+)"
DROP = re.compile(rf"^\s*drop\s+table\s+(?P<lenient>if\s+exists\s+)?{NAME}\s*;?\s*$", re.IGNORECASE)
EXTERNAL = re.compile(rf"^\s*create\s+external\s+table\s+(?P<lenient>if\s+not\s+exists\s+)?{NAME}\s+(?:stored\s+as\s+\w+\s+)?location\s+'(?P<location>[^']+)'\s*;?\s*$", re.IGNORECASE)
CREATE = re.compile(rf"^\s*create\s+table\s+(?P<lenient>if\s+not\s+exists\s+)?{NAME}\s*\((?P<columns>.+?)\)\s*(?:partitioned\s+by\s*\((?P<parts>.*)\)\s*)?;?\s*$", re.IGNORECASE | re.DOTALL)
#: month(c), bucket(8, c), truncate(10, c), or a column.
PART = re.compile(r"\s*(?:(\w+)\s*\(\s*(?:(\d+)\s*,\s*)?`?(\w+)`?\s*\)|`?(\w+)`?)\s*(?:,|$)")


def parse_ddl(sql: str) -> Definition | None:
    if m := DROP.match(sql):
        return Definition("drop", m["name"], bool(m["lenient"]))
    if m := EXTERNAL.match(sql):
        return Definition("external", m["name"], bool(m["lenient"]), location=m["location"])
    if m := CREATE.match(sql):
        parts = [(p[3], p[1].lower() + (f"[{p[2]}]" if p[2] else "")) if p[1] else p[4] for p in PART.finditer(m["parts"] or "") if p[0].strip()]
        return Definition("table", m["name"], bool(m["lenient"]), m["columns"].strip(), tuple(parts))
    return None


def quote_metadata_tables(sql: str) -> str:
    return "".join(x if quoted else META.sub(r"\1`\2$\3`", x) for quoted, x in outside_quotes(sql))


def hint(message: str) -> str:
    """Errors about names say how names are looked up."""
    out = f"plan sql: {message}"
    if re.search(r"TABLE_OR_VIEW_NOT_FOUND|not found|cannot be found", message, re.IGNORECASE):
        out += "\nhint: tables are named [catalog.]namespace.table; SHOW TABLES IN namespace lists them"
    return out
