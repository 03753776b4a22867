"""Placement of pieces against packing them one by one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from postroom.llm import sequence_packing as sp


def one_by_one(lengths: list[int], capacity: int) -> list[list[int]]:
    """The stated method on single pieces: large ones, then matches, pairs, and best fit of the small ones."""
    large = sorted((n for n in lengths if 2 * n > capacity), reverse=True)
    middle = sorted((n for n in lengths if 2 * n <= capacity < 3 * n), reverse=True)
    bins = []
    for n in large:
        bins.append([n])
        if fits := [m for m in middle if m <= capacity - n]:
            middle.remove(fits[0])
            bins[-1].append(fits[0])
    bins += [middle[i : i + 2] for i in range(0, len(middle), 2)]
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        gaps = [(capacity - sum(b), i) for i, b in enumerate(bins) if capacity - sum(b) >= n]
        if gaps:
            bins[min(gaps)[1]].append(n)
        else:
            bins.append([n])
    return bins


@pytest.mark.parametrize("seed", range(40))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 64, 100])
    lengths = [min(capacity, max(1, int(rng.lognormvariate(rng.uniform(0, 3.5), 1)))) for _ in range(rng.randrange(1, 300))]
    placed, used = sp.plan(Counter(lengths), capacity)
    filled = defaultdict(list)
    for length, _, count, first, _ in placed:
        for i in range(count):
            filled[first + i].append(length)
    wanted = one_by_one(lengths, capacity)
    assert used == len(filled) == len(wanted)
    assert Counter(map(sum, filled.values())) == Counter(map(sum, wanted))  # bins of one gap are as good as one another


@pytest.mark.parametrize("seed", range(5))
def test_blocks_stay_linear(seed):
    rng = random.Random(seed)
    counts = {n: int(rng.lognormvariate(6, 3)) + 1 for n in range(1, 4097)}
    placed, _ = sp.plan(counts)
    widths, blocks = sp.in_blocks(placed, counts)
    assert len(blocks) <= 2 * len(placed)
    per_block = Counter((length, block) for length, block, *_ in blocks)
    met = sum(n * min(widths[length], counts[length] - block * widths[length]) for (length, block), n in per_block.items())
    assert met <= 3 * sum(counts.values())


def test_two_generations_of_words(monkeypatch):
    from postroom.llm.common import tokenizer_path

    monkeypatch.setattr(sp, "CACHED_WORDS", 20)
    known = sp.WordIds(tokenizer_path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(30):
        words = {f"word{rng.choice('abcdefgh')}{rng.choice('klmnop')}".encode() for _ in range(8)} | {b"x" * 60}
        extra = known.learn(words)
        for word in words:
            ids = extra[word] if word in extra else known[word]
            plain = known.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            assert ids == b"".join(i.to_bytes(4, "little") for i in plain)
        assert len(known) <= 28 and len(known.older) <= 28
