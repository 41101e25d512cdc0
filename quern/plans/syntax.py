"""The syntax tree: frozen values without behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

Value = float | str | bool | None


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Value


@dataclass(frozen=True)
class Member:
    field: str
    values: tuple[Value, ...]
    wanted: bool


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class Not:
    of: Compare | Member | Exists


@dataclass(frozen=True)
class Both:
    left: Condition
    right: Condition


@dataclass(frozen=True)
class Either:
    left: Condition
    right: Condition


Condition = Compare | Member | Exists | Not | Both | Either


@dataclass(frozen=True)
class Change:
    """op: $quy (set), $don (push) or $loi (pull)."""

    op: str
    field: str
    value: Value


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str

    @property
    def name(self) -> str:
        return f"{self.function}_{self.field}"


@dataclass(frozen=True)
class Lookup:
    target: str
    local: str
    foreign: str
    alias: str


@dataclass(frozen=True)
class Query:
    verb: str
    collection: str = ""
    where: Condition | None = None
    group: str | None = None
    aggregates: tuple[Aggregate, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    lookup: Lookup | None = None
    documents: tuple[dict[str, Value], ...] = ()
    changes: tuple[Change, ...] = ()
    inner: Query | None = field(default=None)
