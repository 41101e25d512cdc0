"""Statements to syntax trees, by recursive descent."""

from __future__ import annotations

from quern.errors import EngineError

from .syntax import Aggregate, Both, Change, Compare, Condition, Either, Exists, Lookup, Member, Not, Order, Query, Value
from .tokens import AGGREGATES, COMPARISONS, VERBS, Token, tokenize

_WITHOUT_NAME = ("ginan", "cometi", "tulaberk")
_CHANGES = ("$quy", "$don", "$loi")
_JOINED_BY = ("tu", "từ", "from")


def parse(statement: str) -> Query:
    """The tree of one statement; a closing semicolon is allowed."""
    return _Parser(tokenize(statement.strip().removesuffix(";"))).statement()


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    # Reading tokens.

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        token = self.next
        self.at += token.kind != "end"
        return token

    def skip(self, text: str) -> bool:
        if self.next.text == text and self.next.kind in ("keyword", "operator", "mark"):
            self.at += 1
            return True
        return False

    def expect(self, *texts: str) -> None:
        if not any(self.skip(t) for t in texts):
            self.fail(f"expected {' or '.join(texts)}, got {self.next}")

    def fail(self, message: str) -> None:
        raise EngineError("PARSE", message)

    def name(self, what: str) -> str:
        # Keywords that begin no clause here may still name a field.
        if self.next.kind not in ("name", "keyword") or " " in self.next.text:
            self.fail(f"expected {what}, got {self.next}")
        return self.take().text

    # Statements.

    def statement(self) -> Query:
        if self.next.kind == "end":
            self.fail("empty statement")
        verb = self.take().text
        if verb not in VERBS:
            self.fail(f"expected a verb, got {verb}")
        if verb in _WITHOUT_NAME or (verb == "skill" and self.next.kind == "end"):
            return self.finish(Query(verb))
        if verb == "exepanus" and self.next.text in ("funden", "gomail", "cochin", "demlet"):
            return Query(verb, inner=self.statement())
        named = {"verb": verb, "collection": self.name("a collection name")}
        if verb == "vietinfo":
            return self.finish(Query(**named, documents=self.documents()))
        where = self.condition() if verb in ("funden", "demlet", "exepanus", "cochin", "gomail") and self.skip("haar") else None
        if verb == "gomail" and self.skip("gremb bi"):
            named |= {"group": self.name("a field"), "aggregates": self.aggregates()}
        return self.finish(self.trailing(Query(**named, where=where)))

    def finish(self, query: Query) -> Query:
        if self.next.kind != "end":
            self.fail(f"unexpected {self.next}")
        return query

    def trailing(self, query: Query) -> Query:
        """The clauses after the condition, in any order."""
        parts: dict = {}
        while self.next.kind != "end":
            if query.verb == "funden" and self.skip("$rasoat"):
                parts["lookup"] = self.lookup()
            elif query.verb in ("funden", "gomail") and self.skip("orange bi"):
                parts["order"] = self.listed(self.order)
            elif query.verb in ("funden", "gomail") and self.skip("lime"):
                parts["limit"] = self.whole()
            elif query.verb in ("funden", "gomail") and self.skip("skopan"):
                parts["offset"] = self.whole()
            elif query.verb == "cochin" and self.next.text in _CHANGES:
                change = Change(self.take().text, self.name("a field"), self.value())
                parts["changes"] = (*parts.get("changes", ()), change)
            else:
                self.fail(f"unexpected {self.next}")
        return Query(**{**vars(query), **parts})

    def listed(self, one) -> tuple:
        out = [one()]
        while self.skip(","):
            out.append(one())
        return tuple(out)

    def order(self) -> Order:
        field = self.name("a field")
        return Order(field, not self.skip("asc") and self.skip("desc"))

    def aggregates(self) -> tuple[Aggregate, ...]:
        def one() -> Aggregate:
            function = self.take().text
            if function not in AGGREGATES:
                self.fail(f"expected an aggregate, got {function}")
            return Aggregate(function, self.name("a field") if self.next.kind == "name" else "all")

        return self.listed(one)

    def lookup(self) -> Lookup:
        """``target local_field a target_field b`` or ``alias tu target on a $bg b``."""
        first = self.name("a collection name")
        if self.next.text.lower() == "local_field":
            self.take()
            local = self.name("a field")
            if self.take().text.lower() != "target_field":
                self.fail("expected target_field")
            return Lookup(first, local, self.name("a field"), first)
        target = first
        if self.next.text.lower() in _JOINED_BY:
            self.take()
            target = self.name("a collection name")
        self.expect("on")
        local = self.name("a field")
        if self.next.text in COMPARISONS:
            self.take()
        return Lookup(target, local, self.name("a field").removeprefix(f"{target}.").removeprefix(f"{first}."), first)

    def whole(self) -> int:
        token = self.take()
        if token.kind != "number" or "." in token.text or token.text.startswith("-"):
            self.fail(f"expected a whole number, got {token}")
        return int(token.text)

    # Conditions: no parentheses, $vand and $vor of equal rank, from the left.

    def condition(self) -> Condition:
        left = self.unary()
        while self.next.text in ("$vand", "$vor"):
            kind = Both if self.take().text == "$vand" else Either
            left = kind(left, self.unary())
        return left

    def unary(self) -> Condition:
        negated = self.skip("$vnot")
        if negated and self.next.text == "$vnot":
            self.at += 1
            return self.unary()
        found = self.simple()
        return Not(found) if negated else found

    def simple(self) -> Compare | Member | Exists:
        field, op = self.name("a field"), self.take().text
        if op == "$tntt":
            return Exists(field)
        if op in ("$tg", "$ktg"):
            return Member(field, self.values(), op == "$tg")
        if op not in COMPARISONS:
            self.fail(f"expected a comparison, got {op or 'end of statement'}")
        return Compare(field, op, self.value())

    def values(self) -> tuple[Value, ...]:
        if not self.skip("["):
            return (self.value(),)
        out: list[Value] = []
        while not self.skip("]"):
            out.append(self.value())
            if not self.skip(",") and self.next.text != "]":
                self.fail(f"expected , or ], got {self.next}")
        return tuple(out)

    def value(self) -> Value:
        token = self.take()
        if token.kind == "number":
            return float(token.text)
        if token.kind == "string":
            return token.text
        if token.kind in ("name", "keyword"):
            return {"true": True, "false": False, "null": None}.get(token.text.lower(), token.text)
        self.fail(f"expected a value, got {token}")

    # Documents.

    def documents(self) -> tuple[dict[str, Value], ...]:
        if not self.skip("["):
            return (self.document(),) if self.next.kind != "end" else ()
        out = []
        while not self.skip("]"):
            out.append(self.document())
            if not self.skip(",") and self.next.text != "]":
                self.fail(f"expected , or ], got {self.next}")
        return tuple(out)

    def document(self) -> dict[str, Value]:
        self.expect("{")
        out: dict[str, Value] = {}
        while not self.skip("}"):
            key = self.take().text if self.next.kind == "string" else self.name("a field")
            self.expect(":")
            out[key] = self.value()
            if not self.skip(",") and self.next.text != "}":
                self.fail(f"expected , or }}, got {self.next}")
        return out
