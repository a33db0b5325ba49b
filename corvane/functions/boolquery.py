"""A boolean text query language, compiled to a predicate Column.

    query  := any ( OR any )*          any := all of ( [AND] unary )*
    unary  := NOT unary | NEAR ( ( term , term ... ) , n ) | ( query ) | term
    term   := "several words" | word        % in a word stands for any word characters

Text and terms are compared in lower case as sequences of word tokens, runs of letters,
digits and underscores; AND binds more tightly than OR. NEAR holds if two different listed
terms, single words or phrases, stand next to each other without sharing a token, in
either order, and their nearest tokens are at most n places apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS = re.compile(r'\s*(?:(?P<quoted>"[^"]*")|(?P<mark>[(),])|(?P<word>[^\s"(),]+))')
#: Word characters of the token language, alike in Java and RE2.
WORD_CHARS = r"[\p{L}\p{N}_]"

# The query groups of the record search.
QUERY_GROUPS = {
    "Q01": '((CABIN OR "FLIGHT ATTENDANT" OR FA OR PAX OR PASSENGER) AND (CLEAN% OR CATER% OR LAV% OR "CABIN SERVICE" OR GALLEY OR TRASH))',
    "Q02": '((WHEELCHAIR OR "WHEEL CHAIR" OR PRM OR "PASSENGER ASSIST%" OR "SPECIAL ASSIST%" OR MOBILITY) AND (BOARD% OR DEBOARD% OR GATE OR RAMP OR "JET BRIDGE" OR JETWAY))',
    "Q03": '((GATE OR "JET BRIDGE" OR JETWAY OR BOARD% OR DEBOARD%) AND (DELAY% OR HOLD% OR "NOT READY" OR WAIT% OR MISSING OR BOARDING))',
    "Q04": '((RAMP OR "GROUND CREW" OR "GROUND PERSONNEL" OR "GROUND HANDLING" OR "RAMP AGENT") AND (TUG OR TOW% OR PUSHBACK OR "PUSH BACK" OR CHOCK% OR MARSHAL% OR WAND OR "GROUND EQUIPMENT" OR GSE))',
    "Q05": '((BAGGAGE OR BAG OR CARGO OR LOAD% OR ULD OR "WEIGHT AND BALANCE" OR "WT AND BAL") AND (RAMP OR GATE OR BOARD% OR LOAD%))',
    "Q06": '((FUEL OR FUEL% OR REFUEL% OR "FUEL TRUCK") AND (RAMP OR GATE OR DELAY% OR SPILL% OR FUELING))',
    "Q07": '((MAINT% OR MEL OR "MINIMUM EQUIPMENT LIST" OR DEFECT OR DEFER% OR "AIRCRAFT SWAP") AND (GATE OR RAMP OR BOARD% OR CABIN OR PASSENGER OR "BEFORE DEPARTURE" OR PREFLIGHT OR "PRE FLIGHT"))',
    "Q08": '((DISPATCH OR "OPERATIONS" OR "OPERATION CONTROL" OR COMPANY OR COORDINAT% OR COMMUNICAT%) AND (GATE OR RAMP OR BOARD% OR PUSHBACK OR MAINT% OR FUEL%))',
    "Q09": '((CATER% OR CLEAN% OR LAV% OR GALLEY OR "CABIN SERVICE" OR "CABIN READY" OR "CABIN NOT READY") AND (GATE OR BOARD% OR DEBOARD% OR "BEFORE DEPARTURE" OR PREFLIGHT OR "PRE FLIGHT" OR RAMP))',
    "Q10": '(("GATE AGENT" OR "BOARDING DOOR" OR "CABIN DOOR" OR "JET BRIDGE" OR JETWAY OR BOARD% OR DEBOARD%) AND (ARM% OR OPEN% OR CLOSE% OR DELAY% OR WAIT% OR "NOT READY" OR "HAND SIGNAL" OR PAPERWORK))',
    "Q11": '((BAGGAGE OR CARGO OR ULD OR "WEIGHT AND BALANCE" OR "WT AND BAL" OR "LOAD CLOSEOUT" OR "LOAD SHEET") AND (GATE OR RAMP OR BOARD% OR LOAD% OR DEPARTURE OR "BEFORE DEPARTURE"))',
    "Q12": '((FUELING OR REFUEL% OR "FUEL TRUCK" OR FUELER OR "FUEL SPILL" OR "FUEL LEAK") AND (GATE OR RAMP OR "BEFORE DEPARTURE" OR BOARD% OR PUSHBACK))',
    "Q13": '((MAINT% OR MEL OR "MINIMUM EQUIPMENT LIST" OR MECHANIC OR DEFECT OR DEFER% OR "AIRCRAFT SWAP") AND (GATE OR RAMP OR BOARD% OR "BEFORE DEPARTURE" OR PREFLIGHT OR "PRE FLIGHT" OR "CABIN DOOR"))',
    "Q14": '((DISPATCH OR "OPERATIONS" OR "OPERATION CONTROL" OR COORDINAT% OR COMMUNICAT%) AND ("GATE AGENT" OR RAMP OR PUSHBACK OR "LOAD CLOSEOUT" OR FUELING OR MAINT% OR BOARD%))',
}


class QuerySyntaxError(ValueError):
    """The query is not in the language."""


@dataclass(frozen=True)
class Term:
    words: tuple[str, ...]

    def regex(self) -> str:
        """Words between single spaces; a word of % alone is any word."""
        if len(self.words) > 1:
            return " ".join(Term((w,)).regex() for w in self.words)
        if not self.words[0].strip("%"):
            return WORD_CHARS + "+"
        return "".join(WORD_CHARS + "*" if part == "%" else re.escape(part) for part in re.split("(%)", self.words[0]))


@dataclass(frozen=True)
class Node:
    """op: term, not, and, or, near; near has the distance in `n`."""

    op: str
    parts: tuple = ()
    n: int = 0


def parse(query: str) -> Node:
    """The query as a tree."""
    tokens, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = TOKENS.match(query, at)
        if not m:
            raise QuerySyntaxError(f"cannot read the query at {at}")
        kind = m.lastgroup
        tokens.append((kind, m[kind]))
        at = m.end()
    place = 0

    def peek(offset: int = 0) -> tuple[str, str]:
        return tokens[place + offset] if place + offset < len(tokens) else ("end", "")

    def take(text: str | None = None) -> tuple[str, str]:
        nonlocal place
        got = peek()
        if text is not None and got != ("mark", text) or got[0] == "end":
            raise QuerySyntaxError(f"expected {text or 'a term'} but found {got[1] or 'the end'}")
        place += 1
        return got

    def is_word(word: str) -> bool:
        kind, text = peek()
        return kind == "word" and text.upper() == word

    def either() -> Node:
        parts = [both()]
        while is_word("OR"):
            take()
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both() -> Node:
        parts = [unary()]
        while True:
            if is_word("AND"):
                take()
            elif peek()[0] == "end" or is_word("OR") or peek() in (("mark", ")"), ("mark", ",")):
                break
            parts.append(unary())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def unary() -> Node:
        if is_word("NOT"):
            take()
            return Node("not", (unary(),))
        if is_word("NEAR") and peek(1) == ("mark", "("):
            take(), take("("), take("(")
            terms = [term()]
            while peek() == ("mark", ","):
                take()
                terms.append(term())
            take(")"), take(",")
            kind, text = take()
            if kind != "word" or not text.isdigit():
                raise QuerySyntaxError("NEAR needs a distance")
            take(")")
            return Node("near", tuple(terms), int(text))
        if peek() == ("mark", "("):
            take()
            inner = either()
            take(")")
            return inner
        return Node("term", (term(),))

    def term() -> Term:
        kind, text = take()
        if kind == "mark":
            raise QuerySyntaxError(f"unexpected {text}")
        words = tuple(w for w in re.findall(r"[\w%]+", text.strip('"').lower()))
        if not words:
            raise QuerySyntaxError("an empty term")
        return Term(words)

    if not tokens:
        raise QuerySyntaxError("an empty query")
    tree = either()
    if peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {peek()[1]}")
    return tree


def leaves(node: Node) -> list[Term]:
    return [t for p in node.parts for t in ([p] if isinstance(p, Term) else leaves(p))]


def token_text(text: Column) -> Column:
    """Word tokens in lower case, each between single spaces."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, r"[^\p{L}\p{N}_]+", " ")), F.lit(" "))


def near_places(one: Column, length: int, other: Column, other_length: int, n: int) -> Column:
    """Whether a run of `length` tokens at a place of `one` and a run of `other_length`
    at a place of `other` stand apart, the nearest of their tokens at most n places.

    The last places of the first runs and the places of the second merge into one sorted
    list, and then the other way about: the smallest gap is one of two neighbours. A place
    is twice its number, and one more if a run ends there, so that a run that begins where
    another ends comes before it.
    """

    def before(a: Column, size: int, b: Column) -> Column:
        merged = F.array_sort(F.concat(F.transform(a, lambda x: 2 * (x + size - 1) + 1), F.transform(b, lambda x: 2 * x)))
        pairs = F.zip_with(merged, F.slice(merged, 2, 1 << 30), lambda x, y: (x % 2 == 1) & (y % 2 == 0) & (y - x <= 2 * n - 1))
        return F.coalesce(F.exists(pairs, lambda hit: hit), F.lit(False))

    return before(one, length, other) | before(other, other_length, one)


def every_pair(node: Node, places: list[Column]) -> Column:
    """NEAR over the places of its terms."""
    out = F.lit(False)
    for i in range(len(places)):
        for j in range(i + 1, len(places)):
            out = out | near_places(places[i], len(node.parts[i].words), places[j], len(node.parts[j].words), node.n)
    return out


def _near(node: Node, tokens: Column) -> Column:
    """Places of each term's runs of tokens, as arrays within the row."""
    words = F.filter(F.split(tokens, " "), lambda w: w != "")

    def places(term: Term) -> Column:
        runs = words
        for k in range(2, len(term.words) + 1):  # runs grow word by word
            size = F.greatest(F.size(words) - (k - 1), F.lit(0))
            runs = F.zip_with(F.slice(runs, F.lit(1), size), F.slice(words, F.lit(k), size), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.filter(F.transform(runs, lambda w, i: F.when(w.rlike(f"^{term.regex()}$"), i)), lambda i: i.isNotNull())

    return every_pair(node, [places(t) for t in node.parts])


def matches(query: str | Node, text: Column | str) -> Column:
    """Whether the text satisfies the query; a null text has no tokens."""
    tokens = token_text(F.col(text) if isinstance(text, str) else text)

    def build(node: Node) -> Column:
        if node.op == "term":
            return tokens.rlike(f" {node.parts[0].regex()} ")
        if node.op == "not":
            return ~build(node.parts[0])
        if node.op == "near":
            return _near(node, tokens)
        # Alternatives that are plain terms are one alternation.
        if node.op == "or" and all(p.op == "term" for p in node.parts):
            return tokens.rlike(" (?:" + "|".join(p.parts[0].regex() for p in node.parts) + ") ")
        out = build(node.parts[0])
        for part in node.parts[1:]:
            out = out | build(part) if node.op == "or" else out & build(part)
        return out

    return build(parse(query) if isinstance(query, str) else query)
