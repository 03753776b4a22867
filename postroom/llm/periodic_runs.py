"""Repetitions of words: all maximal stretches that repeat a period four times or more, and texts without the repeats.

The method is internal pattern matching. Every block of 2^k words that starts at a multiple of half its length asks
for its next occurrence in the window of its own length that follows: the range successor of its position among the
suffix array's entries that start with the block, answered by a wavelet matrix over the suffix array. A run whose
period q lies in (2^(k-1), 2^k] and that is at least four periods long holds such a block and, q words on, the
same block again; no occurrence can be nearer, for it would give the run a smaller period. So the differences of
neighbouring occurrences are the only candidate periods, blocks that answer alike lie in one progression, and each
progression is stretched to a whole run by comparing words q apart.

Spark splits the documents over tasks; inside a task, documents are laid end to end in portions of some ``PORTION_WORDS`` words
and worked on as arrays. Words are numbered per document, so that nothing matches across documents. Memory grows with
the portion, or the longest document.

Defined results: a null text has no words; an id of null plants nothing; rows that repeat give equal rows; columns
other than id and text take no part; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import WORD, arrow_map

LEAST_LENGTH, LEAST_PERIODS = 6, 4
SHORTEST_BLOCK = 4  # periods 1 to 4; each longer block serves the periods above half its length
PORTION_WORDS = 200_000

RESULT = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, n_dropped long, collapsed string, collapsed_sha256 string"
)


def planted(doc_id: int | None, n: int) -> np.ndarray:
    """Which original word stands at each place: documents with one id in ten repeat a part of themselves."""
    places = np.arange(n)
    if doc_id is None or n == 0:
        return places
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return places
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places[a:] = a + (places[a:] - a) % p
    return places


def groups_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the keys, and per element in that order where its group of equals starts and ends."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    sizes = np.diff(np.append(first, len(keys)))
    return order, np.repeat(first, sizes), np.repeat(first + sizes, sizes)


class SuffixOrder:
    """Suffix array of a sequence of numbers by prefix doubling; groups of equal blocks are kept as intervals.

    From the second doubling on, only places whose block occurs again are sorted further.
    """

    def __init__(self, letters: np.ndarray) -> None:
        self.n = len(letters)
        rank = np.empty(self.n, np.int64)
        order, low, high = groups_of(letters)
        rank[order] = low
        self.open, self.high, self.length = order[high - low > 1], high[high - low > 1], 1
        self.rank = rank

    def double(self) -> bool:
        """From blocks of ``length`` words to twice as many; false if no block occurs twice any more."""
        places = self.open
        if not len(places):
            return False
        follow = places + self.length
        behind = np.where(follow < self.n, self.rank[np.minimum(follow, self.n - 1)], -1)
        base = self.rank[places]
        order, low, high = groups_of(base * (self.n + 1) + behind + 1)
        # places of one former group stay together: the new rank is the group's start plus the rows before in it
        sorted_base = base[order]
        group_start = np.searchsorted(sorted_base, sorted_base, side="left")
        new = sorted_base + (low - group_start)
        self.rank[places[order]] = new
        again = high - low > 1
        self.open, self.high = places[order][again], (new + (high - low))[again]
        self.length *= 2
        return len(self.open) > 0

    def array(self) -> np.ndarray:
        """Places in suffix order (suffixes that were never told apart, by place)."""
        return np.argsort(self.rank, kind="stable")


class WaveletMatrix:
    """Bit planes of a permutation, most significant first, each sorted by the planes above it."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros, self.before = [], []
        current = values
        for bit in range(self.bits - 1, -1, -1):
            one = (current >> bit) & 1
            self.before.append(np.concatenate(([0], np.cumsum(1 - one))))
            self.zeros.append(int(self.before[-1][-1]))
            current = np.concatenate((current[one == 0], current[one == 1]))

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many of the values at ``low`` to ``high`` are smaller than ``limit`` (at most the number of values)."""
        low, high, count = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        whole = limit >> self.bits > 0
        width = high - low
        for plane, bit in enumerate(range(self.bits - 1, -1, -1)):
            before, zeros = self.before[plane], self.zeros[plane]
            zero_low, zero_high = before[low], before[high]
            up = (limit >> bit) & 1 == 1
            count += np.where(up, zero_high - zero_low, 0)
            low = np.where(up, zeros + low - zero_low, zero_low)
            high = np.where(up, zeros + high - zero_high, zero_high)
        return np.where(whole, width, count)

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The ``nth`` smallest value (from 0) at ``low`` to ``high``."""
        low, high, nth, value = low.copy(), high.copy(), nth.copy(), np.zeros(len(low), np.int64)
        for plane, bit in enumerate(range(self.bits - 1, -1, -1)):
            before, zeros = self.before[plane], self.zeros[plane]
            zero_low, zero_high = before[low], before[high]
            inside = zero_high - zero_low
            up = nth >= inside
            nth = np.where(up, nth - inside, nth)
            value += np.where(up, 1 << bit, 0)
            low = np.where(up, zeros + low - zero_low, zero_low)
            high = np.where(up, zeros + high - zero_high, zero_high)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest value above ``value`` at ``low`` to ``high``; -1 without one."""
        nth = self.below(low, high, value + 1)
        has = nth < high - low
        found = np.full(len(low), -1, np.int64)
        found[has] = self.smallest(low[has], high[has], nth[has])
        return found


def candidates(letters: np.ndarray) -> np.ndarray:
    """Rows (first block, last block's end, period) of progressions of blocks with one difference."""
    suffixes = SuffixOrder(letters)
    asked = []
    while suffixes.double():
        block = suffixes.length
        if block >= SHORTEST_BLOCK:
            aligned = suffixes.open % (block // 2) == 0
            places, high = suffixes.open[aligned], suffixes.high[aligned]
            asked.append(np.stack([places, suffixes.rank[places], high, np.full(len(places), block)]))
    if not asked:
        return np.empty((0, 3), np.int64)
    places, low, high, block = np.concatenate(asked, axis=1)
    if not len(places):
        return np.empty((0, 3), np.int64)
    period = WaveletMatrix(suffixes.array()).successor(low, high, places) - places
    fits = (period > 0) & (period <= block) & ((2 * period > block) | (block == SHORTEST_BLOCK))
    places, period, block = places[fits], period[fits], block[fits]
    order = np.lexsort((places, period))
    places, period, block = places[order], period[order], block[order]
    chained = np.zeros(len(places), bool)
    chained[1:] = (period[1:] == period[:-1]) & (places[1:] - places[:-1] <= block[1:])
    first = np.flatnonzero(~chained)
    last = np.flatnonzero(np.append(~chained[1:], True)[: len(places)])
    return np.stack([places[first], places[last] + block[last], period[first]], axis=1)


def stretch(letters: np.ndarray, low: int, high: int, start: int, end: int, q: int) -> tuple[int, int]:
    """Maximal stretch with period ``q`` inside ``low`` to ``high`` around ``start`` to ``end``, by steps that double."""
    step = 64
    while end < high:
        to = min(high, end + step)
        differ = np.flatnonzero(letters[end:to] != letters[end - q : to - q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = to, step * 2
    step = 64
    while start > low:
        to = max(low, start - step)
        differ = np.flatnonzero(letters[to:start] != letters[to + q : start + q])
        if len(differ):
            start = to + int(differ[-1]) + 1
            break
        start, step = to, step * 2
    return start, end


def runs_of(letters: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per document (``bounds`` hold their ends) the runs as (start, length, period), sorted by start and period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    if len(letters) < LEAST_LENGTH:
        return found
    covered = (-1, -1)  # period, end of the last run: rows come sorted by period and place
    for start, end, q in candidates(letters).tolist():
        if covered[0] == q and end <= covered[1]:
            continue
        number = int(np.searchsorted(bounds, start, side="right")) - 1
        low, high = int(bounds[number]), int(bounds[number + 1])
        start, end = stretch(letters, low, high, start, end, q)
        covered = (q, end)
        if end - start >= max(LEAST_LENGTH, LEAST_PERIODS * q):
            found[number].append((start - low, end - start, q))
    return [sorted(set(runs)) for runs in found]


def report(doc_id: int | None, words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """One result row."""
    n, marks = len(words), np.zeros(len(words) + 1, np.int64)
    best = None
    for run in runs:
        start, length, q = run
        marks[start + q] += 1
        marks[start + length] -= 1
        if best is None or length * best[2] > best[1] * q:  # ties: runs come by start, then period
            best = run
    dropped = np.cumsum(marks[:n]) > 0
    kept = [w for w, gone in zip(words, dropped.tolist(), strict=True) if not gone] if runs else words
    listed = "".join(f"{start},{length},{q}\n" for start, length, q in runs)
    collapsed = " ".join(kept)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        doc_id, n, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), n - len(kept), collapsed,
        hashlib.sha256(collapsed.encode()).hexdigest(),
    )


def portion_rows(docs: list[tuple[int | None, list[str]]]) -> Iterator[tuple]:
    """Result rows of some documents, worked on as one sequence whose words are numbered per document."""
    letters, bounds = [], [0]
    for _, words in docs:
        numbers: dict[str, int] = {}
        letters.extend([numbers.setdefault(w, len(numbers)) + bounds[-1] for w in words])
        bounds.append(len(letters))
    runs = runs_of(np.array(letters, np.int64), np.array(bounds))
    for (doc_id, words), some in zip(docs, runs, strict=True):
        yield report(doc_id, words, some)


def find_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", plant: bool = False) -> DataFrame:
    """Per document the number of runs, the one of the greatest exponent, and the text without the repeats.

    ``plant`` first repeats a part of one document in ten, by its id.
    """

    def rows(batch: dict[str, list]) -> Iterator[tuple]:
        held, size = [], 0
        for doc_id, body in zip(batch["id"], batch["body"], strict=True):
            words = WORD.findall(body or "")
            if plant:
                places = planted(doc_id, len(words))
                words = [words[i] for i in places.tolist()]
            held.append((doc_id, words))
            size += len(words)
            if size >= PORTION_WORDS:
                yield from portion_rows(held)
                held, size = [], 0
        yield from portion_rows(held)

    read = docs.select(F.col(key).alias("id"), F.col(text).alias("body"))
    return arrow_map(read, rows, RESULT)
