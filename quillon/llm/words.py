"""Words of many texts at once, in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words of letters and digits: all ASCII but these, with A-Z lowered.
#: Bytes of characters beyond ASCII belong to words.
LETTERS_DIGITS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256)
)

#: Longest run of bytes hashed at once.
STEP = 1 << 20


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, and a value per byte."""
    base = 0x9E3779B97F4A7C15
    up = np.full(STEP, base, np.uint64)
    down = np.full(STEP, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), values


def mixed(h: np.ndarray) -> np.ndarray:
    """The bits of 64-bit hashes, spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words in spaced bytes.

    Equal words have equal hashes wherever they stand, in every process; hashes are never 0.
    """

    def __init__(self) -> None:
        self.up, self.down, self.values = _powers()

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of `data`, which are apart by space bytes."""
        found = [self._part(data, a, b) for a, b in self._cuts(data)]
        if not found:
            none = np.empty(0, np.int64)
            return none, none, np.empty(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    @staticmethod
    def _cuts(data: bytes) -> Iterator[tuple[int, int]]:
        """Parts of about STEP bytes, cut at spaces; a longer word makes a longer part."""
        at = 0
        while at < len(data):
            end = len(data)
            if end - at > STEP:
                end = data.rfind(b" ", at, at + STEP) + 1 or data.find(b" ", at) + 1 or end
                end = end if end > at else len(data)
            yield at, end
            at = end

    def _part(self, data: bytes, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bytes_ = np.frombuffer(data, np.uint8, b - a, a)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], bytes_ != 32, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        if b - a > STEP:  # one word longer than a part
            up = np.full(b - a, self.up[1], np.uint64)
            up[0] = 1
            up = np.multiply.accumulate(up)
            inverse = np.array([pow(int(self.down[1]), int(s), 1 << 64) for s in starts], np.uint64)
        else:
            up, inverse = self.up[: b - a], self.down[starts]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(self.values[bytes_] * up, out=sums[1:])
        h = mixed((sums[ends] - sums[starts]) * inverse)
        h[h == 0] = 1
        return starts + a, ends + a, h


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about `most`, or of a single larger one."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
