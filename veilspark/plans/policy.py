"""Which tables are privacy units, how others link to them, and which columns are protected."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path


class PolicyError(ValueError):
    """A statement that the policy doesn't allow."""


@dataclass(frozen=True)
class Link:
    """A logical foreign key."""

    columns: tuple[str, ...]
    table: str
    referenced: tuple[str, ...]


@dataclass(frozen=True)
class TablePolicy:
    name: str
    key: tuple[str, ...] = ()
    links: tuple[Link, ...] = ()
    protected: tuple[str, ...] = ()
    is_unit: bool = False


def _low(names: Iterable[str]) -> tuple[str, ...]:
    return tuple(n.strip().lower() for n in names)


@dataclass
class Registry:
    """The policies of a session by lower-case table name."""

    tables: dict[str, TablePolicy] = field(default_factory=dict)

    def get(self, name: str) -> TablePolicy:
        return self.tables.get(name.lower(), TablePolicy(name.lower()))

    def put(self, policy: TablePolicy) -> None:
        self._validate(policy)
        self.tables[policy.name] = policy

    def unit(self, name: str, key: Iterable[str] = (), protected: Iterable[str] = (), links: Iterable[Link] = ()) -> None:
        self.put(TablePolicy(name.lower(), _low(key), tuple(links), _low(protected), True))

    def link(self, name: str, columns: Iterable[str], table: str, referenced: Iterable[str]) -> None:
        """Adds a link; the same link again changes nothing, another target of the same columns is an error."""
        new = Link(_low(columns), table.lower(), _low(referenced))
        if len(new.columns) != len(new.referenced):
            raise PolicyError("a link must have as many columns as it references")
        old = self.get(name)
        if new in old.links:
            return
        if any(x.columns == new.columns for x in old.links):
            raise PolicyError(f"column(s) {', '.join(new.columns)} of {name} already link to another table")
        self.put(replace(old, links=(*old.links, new)))

    def set_key(self, name: str, columns: Iterable[str]) -> None:
        self.put(replace(self.get(name), key=_low(columns)))

    def protect(self, name: str, columns: Iterable[str]) -> None:
        old, new = self.get(name), _low(columns)
        if twice := [c for c in new if c in old.protected]:
            raise PolicyError(f"column {twice[0]} of {name} is already protected")
        self.put(replace(old, protected=old.protected + new))

    def unprotect(self, name: str, columns: Iterable[str]) -> None:
        old, gone = self.get(name), _low(columns)
        if absent := [c for c in gone if c not in old.protected]:
            raise PolicyError(f"column {absent[0]} of {name} is not protected")
        self.put(replace(old, protected=tuple(c for c in old.protected if c not in gone)))

    def unlink(self, name: str, columns: Iterable[str]) -> None:
        old, gone = self.get(name), _low(columns)
        kept = tuple(x for x in old.links if x.columns != gone)
        if len(kept) == len(old.links):
            raise PolicyError(f"{name} has no link of {', '.join(gone)}")
        self.put(replace(old, links=kept))

    def set_unit(self, name: str, on: bool = True) -> None:
        self.put(replace(self.get(name), is_unit=on))

    def drop(self, name: str) -> None:
        """Forgets a table and the links to it."""
        self.tables.pop(name.lower(), None)
        for n, p in list(self.tables.items()):
            self.tables[n] = replace(p, links=tuple(x for x in p.links if x.table != name.lower()))

    def clear(self) -> None:
        self.tables.clear()

    @property
    def units(self) -> list[str]:
        return [n for n, p in self.tables.items() if p.is_unit]

    def _validate(self, p: TablePolicy) -> None:
        if p.is_unit:
            for x in p.links:
                if self.get(x.table).is_unit:
                    raise PolicyError(f"privacy unit {p.name} must not link to privacy unit {x.table}")
        for n, q in self.tables.items():
            if p.is_unit and q.is_unit and n != p.name and any(x.table == p.name for x in q.links):
                raise PolicyError(f"privacy unit {n} must not link to privacy unit {p.name}")

    def key_of(self, unit: str) -> tuple[str, ...]:
        """The unit's key; without one, what links reference."""
        p = self.get(unit)
        if p.key:
            return p.key
        for q in self.tables.values():
            for x in q.links:
                if x.table == unit:
                    return x.referenced
        return ()

    def paths(self, table: str) -> dict[str, list[Link]]:
        """By unit, the shortest chain of links from the table to it; empty for the unit itself."""
        table = table.lower()
        found: dict[str, list[Link]] = {}
        queue, seen = deque([(table, [])]), {table}
        while queue:
            at, path = queue.popleft()
            if self.get(at).is_unit:
                found[at] = path
                continue
            for x in self.get(at).links:
                if x.table not in seen:
                    seen.add(x.table)
                    queue.append((x.table, [*path, x]))
        return found

    def check_cycles(self) -> None:
        state: dict[str, int] = {}

        def visit(n: str) -> None:
            if state.get(n) == 1:
                raise PolicyError(f"links form a cycle through {n}")
            if n not in state:
                state[n] = 1
                for x in self.get(n).links:
                    visit(x.table)
                state[n] = 2

        for n in list(self.tables):
            visit(n)

    def protected_of(self, table: str) -> set[str]:
        """Declared protected columns, a unit's key, and links that lead to a unit."""
        p = self.get(table)
        out = set(p.protected)
        if p.is_unit:
            out |= set(self.key_of(p.name))
        for x in p.links:
            if self.get(x.table).is_unit or self.paths(x.table):
                out |= set(x.columns)
        return out

    def hides_all(self, table: str) -> bool:
        """A unit without protected columns hides all of them."""
        p = self.get(table)
        return p.is_unit and not p.protected

    def to_json(self) -> str:
        return json.dumps({"tables": [{"table_name": p.name, "primary_keys": list(p.key), "links": [{"local_columns": list(x.columns), "referenced_table": x.table, "referenced_columns": list(x.referenced)} for x in p.links], "protected_columns": list(p.protected), "is_privacy_unit": p.is_unit} for p in self.tables.values()]}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Registry:
        out = cls()
        for t in json.loads(text)["tables"]:
            links = tuple(Link(_low(x["local_columns"]), x["referenced_table"].lower(), _low(x["referenced_columns"])) for x in t.get("links", []))
            out.tables[t["table_name"].lower()] = TablePolicy(t["table_name"].lower(), _low(t.get("primary_keys", [])), links, _low(t.get("protected_columns", [])), bool(t.get("is_privacy_unit")))
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load(cls, path: str) -> Registry:
        return cls.from_json(Path(path).read_text())


def read_unit_list(path: str) -> list[str]:
    """Names of units, one a line."""
    return [x.strip().lower() for x in Path(path).read_text().splitlines() if x.strip()]


def delete_unit_list(path: str) -> str:
    p = Path(path)
    if not p.exists():
        return f"{path} does not exist"
    p.unlink()
    return f"deleted {path}"
