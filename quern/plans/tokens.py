"""Words, strings, numbers and operators of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass

from quern.errors import EngineError

# The words of the language, all in any case.
VERBS = ("funden", "vietinfo", "cochin", "demlet", "madeco", "delco", "madecoidu", "delecoidu", "gomail", "ginan", "cometi", "tulaberk", "usf", "skill", "exepanus", "analyze")
CLAUSES = ("haar", "lime", "skopan", "asc", "desc", "tu", "on")
AGGREGATES = ("pou", "sep", "awr", "mie", "maf")
PAIRS = (("orange", "bi"), ("gremb", "bi"))
COMPARISONS = ("$bg", "$kc", "$lh", "$bh", "$lhb", "$bhb", "$xau")
OPERATORS = (*COMPARISONS, "$tg", "$ktg", "$tntt", "$vand", "$vor", "$vnot", "$quy", "$don", "$loi", "$rasoat")

KEYWORDS = frozenset((*VERBS, *CLAUSES, *AGGREGATES))
_LEXEME = re.compile(
    r"""\s*(?:
      "(?P<string>[^"]*)"?
    | (?P<number>-?[0-9]+(?:\.[0-9]+)?)
    | (?P<operator>\$\w*)
    | (?P<word>[^\W\d][\w.]*)
    | (?P<mark>[][{},:])
    )""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    """kind: string, number, operator, keyword, name, mark or end."""

    kind: str
    text: str

    def __str__(self) -> str:
        return self.text or "end of statement"


def tokenize(statement: str) -> list[Token]:
    out: list[Token] = []
    at, end = 0, len(statement.rstrip())
    while at < end:
        found = _LEXEME.match(statement, at)
        if not found or found.end() == at:
            raise EngineError("TOKEN", f"unexpected character {statement[at:].lstrip()[:1]!r}")
        kind, text = found.lastgroup or "", found.group(found.lastgroup or 0)
        if kind == "operator":
            text = text.lower()
            if text not in OPERATORS:
                raise EngineError("TOKEN", f"unknown operator: {text}")
        elif kind == "word":
            kind = "keyword" if text.lower() in KEYWORDS else "name"
            text = text.lower() if kind == "keyword" else text
        out.append(Token(kind, text))
        at = found.end()
    return [*_paired(out), Token("end", "")]


def _paired(tokens: list[Token]) -> list[Token]:
    """Two names that make one keyword become it."""
    out: list[Token] = []
    for token in tokens:
        if out and token.kind == "name" and out[-1].kind == "name" and (out[-1].text.lower(), token.text.lower()) in PAIRS:
            out[-1] = Token("keyword", f"{out[-1].text} {token.text}".lower())
        else:
            out.append(token)
    return out
