"""Many link patterns at once: a pattern is tried only where a literal that every match of it holds occurs."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.joins import BROADCAST_BYTES, measured_bytes, reliable_checkpoint
from pagemill.operators.links import compile_patterns, is_ad_link

LEAST_LITERAL = 2  # characters; shorter literals occur nearly everywhere
# spellings whose meaning differs between the engines: patterns with them are tried everywhere
FOREIGN = re.compile(r"\\[QEbBxuN0kKRXGZz]\S|\(\?[a-zA-Z]*x|&&")


def required_literal(pattern: str) -> tuple[str, bool] | None:
    """The longest literal that every match of a pattern holds, and whether case counts; None where none is sure.

    Read off the parsed pattern: characters in sequence are one literal, whatever may be left out or differ ends it.
    """
    from re import _constants as C
    from re import _parser as P

    if FOREIGN.search(pattern):
        return None
    plain = re.sub(r"\\[pP](\{[^}]*\}|\w)", r"\\d", pattern)
    plain = re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", plain)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = P.parse(plain)
    except (re.error, OverflowError, RecursionError):
        return None
    found, run = [], []

    def close() -> None:
        found.append("".join(run))
        run.clear()

    def walk(part) -> None:
        for op, value in part:
            if op is C.LITERAL:
                run.append(chr(value))
            elif op is C.SUBPATTERN and not value[1] and not value[2]:
                walk(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
                close()
                walk(value[2])
                close()
            else:
                close()
        if part is tree:
            close()

    walk(tree)
    case = not tree.state.flags & re.IGNORECASE
    sure = [x if case else x.lower() for x in found if case or x.isascii()]
    best = max(sure, key=len, default="")
    return (best, case) if len(best) >= LEAST_LITERAL else None


def _candidates(java_patterns: list[tuple[str, str, bool]]) -> Callable[[Column], Column]:
    """Arrow function: the patterns whose literal occurs in a link, by one pass of an automaton over it."""

    @F.pandas_udf("array<string>")
    def candidates(links: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        exact, folded = ahocorasick.Automaton(), ahocorasick.Automaton()
        for automaton, wanted in ((exact, True), (folded, False)):
            by_literal: dict[str, list[str]] = {}
            for pattern, literal, case in java_patterns:
                if case is wanted:
                    by_literal.setdefault(literal, []).append(pattern)
            for literal, patterns in by_literal.items():
                automaton.add_word(literal, patterns)
            automaton.make_automaton()
        for part in links:
            yield part.map(lambda link: _hits(link, exact, folded))

    return candidates


def _hits(link: str | None, exact, folded) -> list[str]:
    found: dict[str, None] = {}
    for automaton, text in ((exact, link), (folded, (link or "").lower())):
        if text and len(automaton):
            for _, patterns in automaton.iter(text):
                found.update(dict.fromkeys(patterns))
    return list(found)


def not_ad_link_table(
    links: DataFrame,
    patterns: DataFrame | Sequence[str],
    link: str = "url",
    on_bad_pattern: str = "error",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Drop links whose absolute URL matches any of many patterns (column ``pattern``, or a list): what `not_ad_link` keeps.

    Every pattern is compiled up front. Of most patterns a literal is known that a match must hold; all literals are looked
    for in one pass over a link, and only the patterns whose literal occurs are tried on it, in the row, with the same
    engine as `not_ad_link`. The others are tried as there. The automaton is given to the tasks when it measures
    ``max_bytes`` at most; a larger table is cut into parts of that size, one behind the other. Links stay where they
    are; null patterns are none.
    """
    spark = links.sparkSession
    if isinstance(patterns, DataFrame):
        table = reliable_checkpoint(patterns.select("pattern").na.drop().distinct())
    else:
        table = spark.createDataFrame([(p,) for p in sorted(set(patterns))], "pattern string")
    parts = max(1, -(-measured_bytes(table) // max_bytes))
    part_of = F.pmod(F.xxhash64("pattern"), F.lit(parts))
    for part in range(parts):
        some = [r["pattern"] for r in table.filter(part_of == part).collect()]  # at most about max_bytes
        java = compile_patterns(links, sorted(some), on_bad_pattern)
        known = [(p, *found) for p in java if (found := required_literal(p)) is not None]
        rest = sorted(set(java) - {p for p, _, _ in known})
        if known:
            tried = F.exists(_candidates(known)(F.col(link)), lambda p: F.rlike(F.col(link), p))
            links = links.filter(~tried)
        if rest:
            links = links.filter(~is_ad_link(F.col(link), rest))
    return links
