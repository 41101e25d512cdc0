"""PII by weak supervision (native).

Candidates of four kinds (email, ip, card, phone) are found by patterns: the
base ones, which always stay, and looser ones, which have to be earned. Three
labelers vote on each candidate, yes, no or not at all: its strict form, a
gazetteer (top-level domains, card prefixes, area codes, reserved networks) and
the words before it. Expectation-maximisation over the table of vote patterns
(at most 27 a kind, whatever the corpus) estimates how reliable each labeler
is. Its posteriors are the labels of the final span classifier, a naive Bayes
model over what the labelers don't look at: the shape of the candidate, its
length and digits, the characters on both sides and the word before, each in a
bounded number of marks (``MARKS``), beside the votes. It says which of the loose
candidates are spans as well. Both are fitted to counts over all candidates.

Offsets are code points: the parts that ``split`` leaves between the matches of
a pattern add up to them. Patterns are possessive and begin only where a run of
their characters begins, so that no text takes them more than linear time; this
changes no match.

Null and empty texts have no spans. Repeated rows each give a row. A kind
without votes keeps its base spans and adds none. An empty table gives an empty
result. ``find`` reads the two columns named only, and these may have any name;
``masked`` leaves all other columns as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, table

KINDS = ("email", "ip", "card", "phone")
#: Spans, the candidate classifier and the query agree on this share.
THRESHOLD = 0.9
MOST_BEFORE = 32
BLOCK = 128

# The base patterns of the kinds; (?<!..)|\G begins at a run's start or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The looser ones.
EMAIL_SPELT = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\]|\{at\})\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]{1,63}+){1,4}+"
IP_SIX = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
PHONE_HOME = r"(?<![0-9+.-])(?<![0-9+][\x20(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])"

#: What the gazetteer knows.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at")
RESERVED = r"^(?:0|10|127|169\.254|192\.168|255)\."
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
AREA = r"^\+?1?[^0-9]*[2-9](?!11)[0-9]{2}"
CUES = {
    "email": "mail|contact|write to|correo|courriel|kontakt",
    "ip": r"\bip\b|server|host|address|client|from",
    "card": "card|visa|credit|debit|payment|karte|carte|tarjeta",
    "phone": r"phone|call|\btel|fax|mobile|telefon|contact",
}
AGAINST = {"email": "example of", "ip": r"version|release|\bv\b", "card": r"isbn|order|serial|\bsku\b|invoice|token|hash", "phone": r"isbn|order|serial|\bsku\b|version"}


def _with(value: Column, use) -> Column:
    """``use(value)``, the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """The items in runs of BLOCK, so that what is built up run by run isn't copied for each item."""

    def cut(x: Column) -> Column:
        last = F.greatest(F.ceil(F.size(x) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))

    return _with(items, cut)


def _spans(text: Column, pattern: str, where: Column, kind: int, strict: bool) -> Column:
    """array<struct<start, kind, end, form, before, after, strict>> of the matches of a pattern, in order."""
    parts, forms = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,form:string,before:string,after:string,strict:boolean>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["part"])
        end = begin + F.char_length(x["form"])
        before = F.lower(F.right(x["part"], F.lit(MOST_BEFORE)))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["form"].alias("form"), before.alias("before"), x["after"].alias("after"), F.lit(strict).alias("strict"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def run(done: Column, block: Column) -> Column:
        start = F.struct(F.element_at(done, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(block, start, step)))

    gap = lambda p, q: F.struct(p.alias("part"), F.left(q, F.lit(1)).alias("after"))
    pair = lambda g, f: F.struct(g["part"].alias("part"), g["after"].alias("after"), f.alias("form"))
    pairs = _with(parts, lambda p: F.zip_with(F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), gap), forms, pair))
    begin = F.array(F.struct(F.lit(0).alias("at"), none.alias("out")))
    found = F.aggregate(_blocks(pairs), begin, run, lambda done: F.flatten(F.transform(done, lambda x: x["out"])))
    return F.when(where, found).otherwise(none)


def _digits(form: Column) -> Column:
    return F.regexp_replace(form, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), F.char_length(digits)),
        F.lit(0),
        lambda acc, i: acc
        + F.when(i % 2 == 1, F.substring(backwards, i, F.lit(1)).cast("int")).otherwise(
            (F.substring(backwards, i, F.lit(1)).cast("int") * 2) % 10 + F.floor(F.substring(backwards, i, F.lit(1)).cast("int") / 5).cast("int")
        ),
    )
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _holds(s: Column) -> Column:
    """Whether a base match meets its kind's further condition."""
    count = F.char_length(_digits(s["form"]))
    return (
        F.when(s["kind"] == 0, F.lit(True))
        .when(s["kind"] == 1, s["form"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(s["kind"] == 2, luhn(_digits(s["form"])))
        .otherwise((count >= 9) & (count <= 15))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), "y").when(F.coalesce(no, F.lit(False)), "n").otherwise("-")


def _votes(s: Column) -> Column:
    """Votes of form, gazetteer and context: three letters."""
    kind, form, digits = s["kind"], s["form"], _digits(s["form"])
    domain = F.lower(F.regexp_extract(form, r"([A-Za-z0-9-]+)$", 1))
    lined = form.rlike(r"^\+?[0-9]+([\x20.-]?[0-9]+)*$") | form.rlike(r"^(\+[0-9]{1,3}\x20)?\([0-9]{3}\)")
    form_yes = F.when(kind == 0, s["strict"]).when(kind == 1, s["holds"] | form.contains(":")).when(kind == 2, s["holds"]).otherwise(lined & s["holds"])
    form_no = F.when(kind == 0, F.lit(False)).when(kind == 1, ~s["holds"]).when(kind == 2, ~s["holds"]).otherwise(~lined)
    known_yes = F.when(kind == 0, domain.isin(*DOMAINS)).when(kind == 1, F.lit(False)).when(kind == 2, digits.rlike(CARD_PREFIX)).otherwise(form.rlike(AREA))
    known_no = F.when(kind == 0, domain.rlike("^[0-9]+$")).when(kind == 1, form.rlike(RESERVED)).when(kind == 2, ~digits.rlike(CARD_PREFIX)).otherwise(digits.rlike("^1?[01]"))
    cue = lambda table_: reduce(lambda acc, i: F.when(kind == i, s["before"].rlike(table_[KINDS[i]])).otherwise(acc), range(1, 4), s["before"].rlike(table_[KINDS[0]]))
    return F.concat(_vote(form_yes, form_no), _vote(known_yes, known_no), _vote(cue(CUES), cue(AGAINST)))


#: How many marks each feature of the classifier has: shape, length, digits, both sides, word before, strict form, three votes.
MARKS = (64, 12, 21, 6, 6, 256, 2, 3, 3, 3)
_FIRST = [sum(MARKS[:i]) for i in range(len(MARKS))]
ALL_MARKS = sum(MARKS)


def _side(c: Column) -> Column:
    """What stands beside a candidate: nothing, a letter, a digit, space, an opening sign, another sign."""
    return F.when(c == "", 0).when(c.rlike(r"\p{L}"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike(r"\s"), 3).when(c.rlike(r"[(\[{<\"':=]"), 4).otherwise(5)


def _marks(s: Column, votes: Column) -> Column:
    """array<int>: one mark of each feature, numbered through."""
    form = s["form"]
    shape = F.regexp_replace(F.regexp_replace(form, "[0-9]+", "9"), "[A-Za-z]+", "a")
    values = [
        F.pmod(F.xxhash64(shape), F.lit(MARKS[0])).cast("int"),
        F.least(F.floor(F.char_length(form) / 4).cast("int"), F.lit(MARKS[1] - 1)),
        F.least(F.char_length(_digits(form)), F.lit(MARKS[2] - 1)),
        _side(F.right(s["before"], F.lit(1))),
        _side(s["after"]),
        F.pmod(F.xxhash64(F.regexp_extract(s["before"], "([a-z]+)[^a-z]*$", 1)), F.lit(MARKS[5])).cast("int"),
        s["strict"].cast("int"),
        *[F.instr(F.lit("yn-"), F.substring(votes, i, 1)) - 1 for i in (1, 2, 3)],
    ]
    return F.array(*[v + first for v, first in zip(values, _FIRST, strict=True)])


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, base, votes, marks>> of a text, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    digits = text.rlike("[0-9]")
    found = F.concat(
        _spans(text, EMAIL, F.contains(text, F.lit("@")), 0, True),
        _spans(text, EMAIL_SPELT, text.rlike(r"[(\[{]at[)\]}]"), 0, False),
        _spans(text, IP, digits & text.rlike(r"[0-9]\.[0-9]"), 1, True),
        _spans(text, IP_SIX, digits & F.contains(text, F.lit(":")), 1, False),
        _spans(text, CARD, digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), 2, True),
        _spans(text, PHONE, F.contains(text, F.lit("+")) & digits, 3, True),
        _spans(text, PHONE_HOME, digits & text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), 3, False),
    )
    checked = F.transform(found, lambda s: s.withField("holds", _holds(s)))
    voted = F.transform(checked, lambda s: s.withField("votes", _votes(s)))
    return F.sort_array(F.transform(voted, lambda s: F.struct(s["start"], s["kind"], s["end"], (s["strict"] & s["holds"]).alias("base"), s["votes"], _marks(s, s["votes"]).alias("marks"))))


def estimate(counts: dict[tuple[int, str], int], rounds: int = 50) -> dict[tuple[int, str], float]:
    """Probability of being a span for each (kind, votes) by EM.

    Labelers are independent given the truth; each has, for a kind, its own
    rates of yes, no and silence among spans and among others. Rates begin
    with the belief that a labeler is right four times in five.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in range(len(KINDS)):
        seen = {v: n for (k, v), n in counts.items() if k == kind}
        belief = {v: (1 + 4 * v.count("y")) / (2 + 4 * v.count("y") + 4 * v.count("n")) for v in seen}
        for _ in range(rounds):
            belief = _round(seen, belief)
        out |= {(kind, v): p for v, p in belief.items()}
    return out


def _round(counts: dict[str, int], belief: dict[str, float]) -> dict[str, float]:
    """Class rates from soft labels, and the labels that they give."""
    sums = [[{a: 0.5 + (2.0 if a == "ny"[c] else 0.0) for a in "yn-"} for _ in range(3)] for c in (0, 1)]
    mass = [1.0, 1.0]
    for v, n in counts.items():
        for c, share in ((0, 1 - belief[v]), (1, belief[v])):
            mass[c] += n * share
            for i in range(3):
                sums[c][i][v[i]] += n * share
    out = {}
    for v in counts:
        odds = [mass[c] for c in (0, 1)]
        for c in (0, 1):
            for i in range(3):
                odds[c] *= sums[c][i][v[i]] / sum(sums[c][i].values())
        out[v] = odds[1] / (odds[0] + odds[1])
    return out


#: So many candidates of a class weigh as much as what both classes have in common.
SHRINK = 20.0


@dataclass(frozen=True)
class Classifier:
    """Log odds of each kind and of each kind's marks."""

    prior: list[float]
    weights: list[float]

    def log_odds(self, s: Column) -> Column:
        table_, prior = F.lit(self.weights), F.lit(self.prior)
        return F.aggregate(s["marks"], F.get(prior, s["kind"]), lambda acc, m: acc + F.get(table_, s["kind"] * ALL_MARKS + m))


def train(counts: dict[tuple[int, str, int], int]) -> Classifier:
    """Naive Bayes from counts of (kind, votes, mark), labelled by EM over the votes.

    A mark's rate in a class is drawn towards its rate in both, so a mark that
    is rare says little. A candidate has one mark of each feature.
    """
    patterns = {(k, v): 0 for k, v, _ in counts}
    for (k, v, m), n in counts.items():
        patterns[k, v] += n if m < MARKS[0] else 0  # each candidate has one shape
    belief = estimate(patterns)
    prior, weights = [0.0] * len(KINDS), [0.0] * (len(KINDS) * ALL_MARKS)
    for kind in range(len(KINDS)):
        mass = [1.0, 1.0]
        for (k, v), n in patterns.items():
            if k == kind:
                mass[1] += n * belief[k, v]
                mass[0] += n * (1 - belief[k, v])
        prior[kind] = math.log(mass[1] / mass[0])
        seen: dict[int, list[float]] = {}
        for (k, v, m), n in counts.items():
            if k == kind:
                both = seen.setdefault(m, [0.0, 0.0])
                both[1] += n * belief[k, v]
                both[0] += n * (1 - belief[k, v])
        for m, (no, yes) in seen.items():
            share = (no + yes) / (mass[0] + mass[1] - 2.0)
            weights[kind * ALL_MARKS + m] = math.log((yes + SHRINK * share) / (mass[1] - 1 + SHRINK)) - math.log((no + SHRINK * share) / (mass[0] - 1 + SHRINK))
    return Classifier(prior, weights)


def fit(spans: DataFrame, column: str = "found") -> Classifier:
    """Train on all candidates; at most 27 vote patterns times ``ALL_MARKS`` counts a kind reach the driver."""
    flat = spans.select(F.explode(column).alias("s")).select("s.kind", "s.votes", F.explode("s.marks").alias("mark"))
    return train({(r["kind"], r["votes"], r["mark"]): r["count"] for r in flat.groupBy("kind", "votes", "mark").count().collect()})


def decide(found: Column, model: Classifier, threshold: float = THRESHOLD) -> Column:
    """The base spans and the accepted others that touch none of them.

    No other span is accepted against as many votes as it has for it.
    """
    base = F.filter(found, lambda s: s["base"])
    votes = lambda s, a: F.char_length(s["votes"]) - F.char_length(F.translate(s["votes"], a, ""))
    least = math.log(threshold / (1 - threshold))
    more = F.filter(found, lambda s: ~s["base"] & (votes(s, "y") > votes(s, "n")) & (model.log_odds(s) >= least))
    cells = lambda spans: F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    shared = F.array_intersect(cells(base), cells(more))  # code points of both, hardly ever any
    free = _with(shared, lambda x: F.filter(more, lambda s: ~F.exists(x, lambda c: (s["start"] <= c) & (c < s["end"]))))
    return F.sort_array(F.concat(base, free))


def _kind_name(k: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in KINDS]), k)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", _kind_name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: Column, spans: Column) -> Column:
    """The text with ``[KIND]`` for each span; overlapping spans become one, under the first one's name."""
    none = F.array().cast("array<string>")

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(acc["here"], acc["at"] - acc["from"] + 1, s["start"] - acc["at"])
        piece = F.concat(between, F.lit("["), F.upper(_kind_name(s["kind"])), F.lit("]"))
        late = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(late, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
            acc["from"].alias("from"),
            acc["here"].alias("here"),
        )

    def run(done: Column, block: Column) -> Column:
        at = F.element_at(done, -1)["at"]
        upto = F.greatest(F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(0)), at)
        start = F.struct(at.alias("at"), none.alias("out"), at.alias("from"), F.substring(text, at + 1, upto - at).alias("here"))
        return F.concat(done, F.array(F.aggregate(block, start, step, lambda acc: F.struct(acc["at"].alias("at"), F.array_join(acc["out"], "").alias("out")))))

    begin = F.array(F.struct(F.lit(0).alias("at"), F.lit("").alias("out")))
    rest = lambda done: F.substring(text, F.element_at(done, -1)["at"] + 1, F.char_length(text))
    whole = F.aggregate(_blocks(spans), begin, run, lambda done: F.concat(F.array_join(F.transform(done, lambda x: x["out"]), ""), rest(done)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def find(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """``ident`` and ``spans``: array<struct<start, kind, end, base, votes, marks>> of every row."""
    found = materialize(docs.select(ident, candidates(F.col(text)).alias("found")), "spans")
    return found.select(ident, decide(F.col("found"), fit(found)).alias("spans"))


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` masked. Two readings; nothing is shuffled but counts."""
    model = fit(docs.select(candidates(F.col(text)).alias("found")))
    found, spans = free_name(docs, "found"), free_name(docs, "spans")
    seen = docs.withColumn(found, candidates(F.col(text)))
    return seen.withColumn(spans, decide(F.col(found), model)).withColumn(text, mask(F.col(text), F.col(spans))).drop(found, spans)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: lambda s: s["kind"] == k  # noqa: E731 (a second parameter of the inner one would be the place in the array)
    counts = [F.size(F.filter(base, of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
