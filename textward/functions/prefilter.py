"""What a text must hold for a pattern to match: literals read off the pattern, tested before the pattern is.

A pattern's syntax tree gives clauses; a clause is a set of needles of which any match holds one. A needle is a literal of
ASCII characters, in small letters, or ``DIGIT``. A text is made small and searched for a catalog's needles once; a pattern
reads the text only if each of its clauses has a needle there. On 10,000 documents a search for one literal takes about a
tenth of the time of one pattern; one alternation of 26 literals took 2.5 times the 26 searches, so there is none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants as sre
    from re import _parser as parser
except ImportError:  # Python 3.10
    import sre_constants as sre  # type: ignore[no-redef]
    import sre_parse as parser  # type: ignore[no-redef]

DIGIT = r"\d"
#: Not ASCII, but equal to an ASCII letter where case is ignored.
ODD = "ſKıİ"
#: How often a character of a kind is thought to occur; a rare needle is worth a search.
USUAL = {"letter": 0.05, "space": 0.15, "digit": 0.02, "stop": 0.02, "other": 0.002}
#: A clause that is thought to hold more often than this is no test.
WORTH = 0.025
Clause = frozenset[str]


def often(needle: str) -> float:
    if needle == DIGIT:
        return USUAL["digit"]
    kind = lambda c: "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "stop" if c in ".,-'" else "other"
    return reduce(lambda a, c: a * USUAL[kind(c)], needle, 1.0)


def cost(clause: Clause) -> float:
    return sum(map(often, clause))


def clauses(tree, held: str = "") -> list[Clause]:
    """The clauses of a sequence of a syntax tree, best first; ``held`` is the literal right before it."""
    out: list[Clause] = []

    def flush() -> None:
        nonlocal held
        if held:
            out.append(frozenset([held]))
        held = ""

    def walk(items) -> None:
        nonlocal held
        for op, arg in items:
            if op is sre.LITERAL and arg < 128:
                held += chr(arg).lower()
            elif op is sre.AT:
                continue  # takes no character: a literal goes on behind it
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op is getattr(sre, "ATOMIC_GROUP", None):
                walk(arg)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
                least, most, body = arg
                flush()
                if least:
                    inner = clauses(body)
                    single = len(body) == 1 and body[0][0] is sre.LITERAL and body[0][1] < 128
                    out.extend([frozenset([chr(body[0][1]).lower() * least])] if single else inner)
            elif op is sre.BRANCH:
                each = [clauses(b, held) for b in arg[1]]
                flush()
                if all(each):
                    some = frozenset().union(*(c[0] for c in each))
                    # a needle with a digit in it says no more than that there is one
                    out.append(frozenset(n for n in some if n == DIGIT or DIGIT not in some or not any(map(str.isdigit, n))))
            elif op is sre.IN:
                flush()
                if chars := members(arg):
                    out.append(chars)
            else:
                flush()

    walk(tree)
    flush()
    return sorted(set(out), key=lambda c: (cost(c), sorted(c)))


def members(items) -> Clause | None:
    """Digits as DIGIT, a few characters as needles; None for larger and negated classes."""
    out: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL and arg < 128:
            out.add(DIGIT if chr(arg).isdigit() else chr(arg).lower())
        elif op is sre.RANGE and chr(arg[0]).isdigit() and chr(arg[1]).isdigit() and arg[1] < 128:
            out.add(DIGIT)
        elif op is sre.CATEGORY and arg in (sre.CATEGORY_DIGIT, sre.CATEGORY_UNI_DIGIT):
            out.add(DIGIT)
        else:
            return None
    return frozenset(out) if 0 < len(out) <= 4 else None


def required(pattern: str) -> list[Clause]:
    """The clauses of a pattern, the best first; none where nothing is known. Case is ignored, whether or not the pattern does so."""
    return clauses(parser.parse(pattern))


class Prefilter:
    """A catalog's needles and, for each pattern, the clauses to test."""

    def __init__(self, patterns: list[str]):
        known = [[c for c in required(p) if cost(c) < WORTH] for p in patterns]
        self.needles: list[str] = []
        for own in known:
            # the best clause, and another if it is much rarer than a single character is
            for c in own[:1] + [c for c in own[1:2] if cost(own[0]) > 0.002 > cost(c)]:
                self.needles += sorted(c.difference(self.needles))
        # other clauses of needles that are searched for anyway cost nothing
        self.clauses = [[c for c in own if c <= set(self.needles)] for own in known]
        folded = [bool(re.search(r"\(\?[a-zA-Z]*i", p)) for p in patterns]
        self.odd = [f and any(set(n) & set("ski") for c in own for n in c if n != DIGIT) for f, own in zip(folded, self.clauses, strict=True)]
        # a needle whose patterns all ask for a digit is searched for only in texts with one
        users = {n: [own for own in self.clauses if any(n in c for c in own)] for n in self.needles}
        hub = frozenset([DIGIT])
        self.behind = {n for n, own in users.items() if n != DIGIT and own and all(hub in clauses_ for clauses_ in own)}
        self.needles.sort(key=lambda n: n != DIGIT)

    def flags(self, text: Column) -> Column:
        """array<boolean>: for each needle whether the text has it; then whether it has an odd letter."""

        def build(low: Column) -> Column:
            odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in ODD]) if any(self.odd) else F.lit(False)
            plain = lambda digit: [digit if n == DIGIT else (digit & F.contains(low, F.lit(n)) if n in self.behind else F.contains(low, F.lit(n))) for n in self.needles]
            if DIGIT not in self.needles:
                return F.array(*plain(F.lit(False)), odd)
            return F.transform(F.array(text.rlike(r"(?U)\d")), lambda digit: F.array(*plain(digit), odd))[0]

        return F.transform(F.array(F.lower(text)), build)[0]

    def may(self, flags: Column, i: int) -> Column:
        """Whether pattern i may match, by its clauses."""
        at = lambda n: flags[self.needles.index(n)]
        if not self.clauses[i]:
            return F.lit(True)
        every = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [at(n) for n in sorted(c)]) for c in self.clauses[i]])
        return every | flags[len(self.needles)] if self.odd[i] else every

    def sql(self, col: str, i: int) -> str:
        """The same in DuckDB's SQL."""
        lit = lambda x: "'" + x.replace("'", "''") + "'"
        one = lambda n: f"regexp_matches({col}, '\\p{{Nd}}')" if n == DIGIT else f"contains(lower({col}), {lit(n)})"
        if not self.clauses[i]:
            return "true"
        every = " and ".join("(" + " or ".join(map(one, sorted(c))) + ")" for c in self.clauses[i])
        return f"(({every})" + (" or " + " or ".join(f"contains({col}, '{c}')" for c in ODD) if self.odd[i] else "") + ")"


@lru_cache(maxsize=64)
def _made(patterns: tuple[str, ...]) -> Prefilter:
    return Prefilter(list(patterns))


def prefilter(patterns: list[str]) -> Prefilter:
    """A catalog's prefilter, made once."""
    return _made(tuple(patterns))


def guarded(text: Column, patterns: list[str], then: Callable[[Callable[[int], Column]], Column]) -> Column:
    """``then(may)``, where ``may(i)`` says whether pattern i may match; the needles are searched for once. A null text has none."""
    made = prefilter(patterns)
    return F.transform(F.array(made.flags(F.coalesce(text, F.lit("")))), lambda f: then(lambda i: made.may(f, i)))[0]


def n_tests(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns a text is read with."""
    return guarded(text, patterns, lambda may: reduce(lambda a, b: a + b, [may(i).cast("long") for i in range(len(patterns))]))
