"""Periodic runs of words, found by recursive frequency splitting.

A run is a longest stretch of words with smallest period q that is at least ``LEAST_LENGTH`` words and ``LEAST_TURNS``
periods long. Each of its words occurs at least ``LEAST_TURNS`` times in it, so a word that occurs less often inside
the current segment lies in no run and splits the segment; the parts are counted anew until none splits. What survives
is scanned lag by lag: a run with period q has equal words at ``LEAST_TURNS`` neighbouring multiples of q, so a lag
looks at n / q places, and all lags together at n log n.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from pagemill.llm.common import slices

LEAST_LENGTH = 6  # words of a run
LEAST_TURNS = 4  # periods of a run
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
STEP = 256  # words compared at first when a stretch is extended; doubled as long as all are equal


class Run(NamedTuple):
    start: int
    length: int
    period: int


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text or "")


def coded(words: list[str]):
    """Words as numbers, equal ones alike."""
    import numpy as np

    codes: dict[str, int] = {}
    return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)


def segments(codes) -> list[tuple[int, int]]:
    """Stretches ``(start, end)`` in which every word occurs at least ``LEAST_TURNS`` times, each at least
    ``LEAST_LENGTH`` long; every run lies in one. A segment that no word splits is not counted again."""
    import numpy as np

    done, todo = [], [(0, len(codes))]
    while todo:
        start, end = todo.pop()
        if end - start < LEAST_LENGTH:
            continue
        inside = codes[start:end]
        if len(inside) == len(codes):
            of, times = codes, np.bincount(codes)
        else:
            _, of, times = np.unique(inside, return_inverse=True, return_counts=True)
        rare = np.flatnonzero(times[of] < LEAST_TURNS)
        if not len(rare):
            done.append((start, end))
            continue
        borders = np.concatenate([[-1], rare, [end - start]])
        for k in np.flatnonzero(np.diff(borders) > LEAST_LENGTH):
            todo.append((start + int(borders[k]) + 1, start + int(borders[k + 1])))
    return sorted(done)


def _reach(codes, at: int, lag: int, end: int) -> int:
    """First place from ``at`` on whose word differs from the one ``lag`` later (both before ``end``)."""
    import numpy as np

    step, last = STEP, end - lag
    while at < last:
        stop = min(last, at + step)
        differs = codes[at:stop] != codes[at + lag : stop + lag]
        if differs.any():
            return at + int(np.argmax(differs))
        at, step = stop, 2 * step
    return max(at, last)


def _back(codes, at: int, lag: int, start: int) -> int:
    """Smallest place down to ``start`` from which all words up to ``at`` equal those ``lag`` later."""
    import numpy as np

    step = STEP
    while at > start:
        low = max(start, at - step)
        differs = codes[low:at] != codes[low + lag : at + lag]
        if differs.any():
            return at - int(np.argmax(differs[::-1]))
        at, step = low, 2 * step
    return at


class _Found:
    """Runs found so far, to ask whether a stretch lies inside one of them."""

    def __init__(self):
        self.runs: list[Run] = []
        self.starts = self.reach = None

    def add(self, runs: list[Run]) -> None:
        import numpy as np

        if runs:
            self.runs = sorted(self.runs + runs)
            self.starts = np.array([r.start for r in self.runs])
            self.reach = np.maximum.accumulate([r.start + r.length for r in self.runs])

    def cover(self, starts, ends):
        import numpy as np

        if not self.runs:
            return np.zeros(len(starts), bool)
        before = np.searchsorted(self.starts, starts, side="right") - 1
        return (before >= 0) & (self.reach[np.maximum(before, 0)] >= ends)


def _scan(codes, start: int, end: int) -> list[Run]:
    """Runs of one segment, by lag.

    A candidate or stretch inside a run with a smaller period is passed over: where both periods held they would share
    a divisor as period, so the stretch would be that run itself, and its smallest period is not this lag.
    """
    import numpy as np

    found, inside = _Found(), codes[start:end]
    for lag in range(1, (end - start) // LEAST_TURNS + 1):
        picked = inside[::lag]
        equal = picked[1:] == picked[:-1]
        hit = equal[: len(equal) - LEAST_TURNS + 2].copy()
        for k in range(1, LEAST_TURNS - 1):
            hit &= equal[k : len(equal) - LEAST_TURNS + 2 + k]
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        at = start + at * lag
        at = at[~found.cover(at, at + (LEAST_TURNS - 1) * lag + 1)]
        new, past = [], -1
        for place in at.tolist():
            if place < past:
                continue
            reach = _reach(codes, place, lag, end)
            past = reach  # candidates up to here belong to the same stretch
            low = _back(codes, place, lag, start)
            length = reach + lag - low
            if length >= max(LEAST_LENGTH, LEAST_TURNS * lag) and not found.cover([low], [low + length])[0]:
                new.append(Run(low, length, lag))
        found.add(new)
    return found.runs


def runs_of(words: list[str]) -> list[Run]:
    """All runs of a list of words, by start, then period."""
    if len(words) < LEAST_LENGTH:
        return []
    codes = coded(words)
    return sorted((r for part in segments(codes) for r in _scan(codes, *part)), key=lambda r: (r.start, r.period))


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length over period; ties: smallest start, then period. Compared in whole numbers."""
    best = None
    for r in runs:  # by start, then period, so an equal one later is no better
        if best is None or r.length * best.period > best.length * r.period:
            best = r
    return best


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    import numpy as np

    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


FIGURES = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
WHOLE = "collapsed string, runs array<struct<start: long, length: long, period: long>>"


def _judged(words: list[str]) -> tuple:
    runs = runs_of(words)
    best = strongest(runs)
    listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
    kept = " ".join(collapsed(words, runs))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
    return (len(runs), *four, digest(listed), digest(kept), kept, [r._asdict() for r in runs])


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prepare: Callable[[int | None, list[str]], list[str]] | None = None,
    whole: bool = True,
) -> DataFrame:
    """One row per row of ``docs``: its id and ``n_runs``; ``start, length, period, exponent_milli`` of its strongest
    run (nulls without one); ``runs_sha256`` and ``collapsed_sha256``, the digests of the list of runs and of the text
    whose runs are cut to one period; with ``whole`` also ``collapsed``, that text, and ``runs``. Map-only, a text at a
    time.

    A null or empty text has no words. A null id stays null. Repeated rows are judged one by one; other columns are not
    read, so clashing names do not matter. ``prepare`` may change the words of a row, given its id.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = f"`{id_col}` {types[id_col]}, {FIGURES}" + (f", {WHOLE}" if whole else "")

    def judge(batches: Iterable) -> Iterator:
        import pyarrow as pa

        number, text = pa.int64(), pa.string()
        run = pa.list_(pa.struct([("start", number), ("length", number), ("period", number)]))
        kinds = [*[number] * 5, text, text, *([text, run] if whole else [])]
        names = [id_col, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        names += ["collapsed", "runs"] if whole else []
        for batch in slices(batches):
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(value.as_py())
                rows.append(_judged(prepare(key, words) if prepare else words)[: len(kinds)])
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(id_col, text_col).mapInArrow(judge, schema)
