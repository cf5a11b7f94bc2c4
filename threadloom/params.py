"""Parameters of the similarity join and the random tables that follow from them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count
from string import ascii_uppercase, digits

#: Letters by alphabet size; a letter's code is its place. 25 is not offered, as Z would have no code.
ALPHABETS = {4: "ACGT", 5: "ACGTN", 26: ascii_uppercase, 37: ascii_uppercase + digits + " "}
#: Stands for a sampled position that the walk did not reach. A non-character, so no text holds it.
UNREACHED = "￿"
SEED = 11110


def libc_rand(seed: int = SEED) -> Iterator[int]:
    """The additive-feedback generator behind C's ``rand()``: a linear congruence fills 31 words, then each word is
    the sum of those 3 and 31 before it; the first 310 are thrown away and each output drops its lowest bit."""
    first = [seed]
    while len(first) < 31:
        first.append(16807 * first[-1] % 0x7FFFFFFF)
    ring = deque(first[3:] + first[:3], maxlen=31)
    for n in count():
        ring.append((ring[-3] + ring[-31]) & 0xFFFFFFFF)
        if n >= 310:
            yield ring[-1] >> 1


@dataclass(frozen=True)
class JoinParams:
    """What a join computes. Names in brackets are the usual symbols.

    ``num_str`` (r): random strings; ``num_hash`` (z): hash functions for each; ``num_bits`` (m): positions a hash function
    samples; ``alphabet``: 4, 5, 26 or 37 letters; ``k`` (K): edit threshold, inclusive; ``shift``: step between the suffixes
    that are embedded; ``sampling_range`` (s): positions are drawn below it; ``count_filter`` (c): a pair needs more
    collisions than this; ``hash_size``: modulus of the bucket numbers; ``min_pts``: neighbourhood of a core
    point, itself included; ``chunk_size``: strings that are clustered together.
    """

    num_str: int = 7
    num_hash: int = 16
    num_bits: int = 12
    alphabet: int = 4
    k: int = 150
    shift: int = 50
    sampling_range: int = 91
    count_filter: int = 0
    hash_size: int = 1000003
    min_pts: int = 10
    chunk_size: int = 100_000
    second_level_min_pts: int | None = None
    seed: int = SEED

    def __post_init__(self):
        if self.alphabet not in ALPHABETS:
            raise ValueError(f"alphabet must be one of {sorted(ALPHABETS)}")
        for name in ("num_str", "num_hash", "num_bits", "shift", "sampling_range", "chunk_size", "min_pts"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.k < 0 or self.count_filter < 0 or self.hash_size < 2:
            raise ValueError("k and count_filter may not be negative, hash_size must exceed 1")
        if self.num_rep > 127:
            raise ValueError("at most 127 suffixes")

    @property
    def num_rep(self) -> int:
        """Suffixes embedded of each string: k / shift, rounded up."""
        return -(-self.k // self.shift)

    @property
    def letters(self) -> str:
        return ALPHABETS[self.alphabet]

    @cached_property
    def _tables(self) -> tuple[list[list[int]], list[int], list[list[list[int]]]]:
        draw = libc_rand(self.seed)
        positions = [[next(draw) % self.sampling_range for _ in range(self.num_bits)] for _ in range(self.num_hash)]
        weights = [next(draw) % (self.hash_size - 1) for _ in range(self.num_bits)]
        size = max(map(max, positions)) + 1
        walks = []
        for _ in range(self.num_str):
            rows = []
            for _ in range(self.alphabet):
                bits = [1 - next(draw) % 2 for _ in range(size)]
                run, runs = 0, []
                for bit in reversed(bits):
                    run = run + 1 if bit else 0
                    runs.append(run)
                rows.append(runs[::-1])
            walks.append(rows)
        return positions, weights, walks

    @property
    def positions(self) -> list[list[int]]:
        """Sampled positions of each hash function, with repetition. Drawn first."""
        return self._tables[0]

    @property
    def weights(self) -> list[int]:
        """Factor of each sampled letter in a bucket's number; the same for all hash functions. Drawn second."""
        return self._tables[1]

    @property
    def walks(self) -> list[list[list[int]]]:
        """[random string][letter code][position]: how often the letter is repeated there. Drawn third."""
        return self._tables[2]

    @property
    def last_position(self) -> int:
        """Largest sampled position; the walk ends there."""
        return max(map(max, self.positions))


#: The settings that the command line's examples use.
SMALL = JoinParams(num_str=5, num_hash=7, num_bits=12, alphabet=4, k=6, shift=6, sampling_range=91, count_filter=0, min_pts=3)
