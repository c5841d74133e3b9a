"""Edit distances of one text to many at a time: each bit of a word is another text's cell of the table. A diagonal of all
tables is worked on at once, as the differences between neighbouring cells, so that nothing is carried from bit to bit."""

from __future__ import annotations

import numpy as np


class Batch:
    """Texts laid out for `to`; those of like length are best kept together."""

    def __init__(self, texts: list[str]):
        self.n_texts, self.length = len(texts), np.array([len(t) for t in texts], dtype=np.int64)
        words, n = -(-len(texts) // 64), int(self.length.max(initial=0))
        signs = np.zeros((n, words * 64), dtype=np.int64)
        for k, t in enumerate(texts):
            signs[: len(t), k] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) + 1
        kinds = np.unique(signs[signs > 0])
        self.place = {int(s) - 1: k for k, s in enumerate(kinds)}
        self.equal = np.zeros((len(kinds) + 1, n, words), dtype=np.uint64)  # the last one is for signs that no text has
        for k, s in enumerate(kinds):
            self.equal[k] = self._bits(signs == s)
        self.inside = self._bits(signs > 0)
        self.n, self.words = n, words
        self.flat = self.equal.reshape(-1, words)

    @staticmethod
    def _bits(yes: np.ndarray) -> np.ndarray:
        return np.packbits(yes, axis=1, bitorder="little").view("<u8")

    def to(self, text: str) -> np.ndarray:
        """The edit distance of `text` to each text of the batch."""
        n, m = self.n, len(text)
        if not n or not m:
            return np.maximum(self.length, m)
        base = np.array([self.place.get(ord(c), len(self.equal) - 1) for c in reversed(text)], dtype=np.intp) * n
        rows = np.arange(n, dtype=np.intp)
        shape = (n + 1, self.words)
        up, down = np.full(shape, ~np.uint64(0)), np.zeros(shape, dtype=np.uint64)  # of each row, from column to column: vertical
        right, left = up.copy(), down.copy()  # of each column, from row to row: horizontal; the first is that above the table
        right[1:] = 0
        same, t, u, d = (np.empty(shape, dtype=np.uint64) for _ in range(4))
        place = np.empty(n, dtype=np.intp)
        for k in range(n + m - 1):
            low, high = max(0, k - m + 1), min(n, k + 1)
            size = high - low
            # row i is at column k - i, which is at m - 1 - k + i from the text's end
            np.add(base[m - 1 - k + low : m - 1 - k + high], rows[low:high], out=place[:size])
            e, x, y, z = same[:size], t[:size], u[:size], d[:size]
            np.take(self.flat, place[:size], axis=0, out=e, mode="clip")
            vp, vm, hp, hm = up[low:high], down[low:high], right[low:high], left[low:high]
            np.bitwise_or(e, vm, out=e)
            np.bitwise_or(e, hm, out=e)  # equal to the cell before in both
            np.bitwise_or(e, vp, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, vm, out=x)
            np.bitwise_and(e, vp, out=y)
            np.bitwise_or(e, hp, out=z)
            np.invert(z, out=z)
            np.bitwise_or(z, hm, out=vp)
            np.bitwise_and(e, hp, out=vm)
            right[low + 1 : high + 1] = x
            left[low + 1 : high + 1] = y
        return m + self._counted(up[:n]) - self._counted(down[:n])

    def _counted(self, words: np.ndarray) -> np.ndarray:
        ones = np.unpackbits((words & self.inside).view(np.uint8), axis=1, bitorder="little")
        return ones.sum(axis=0, dtype=np.int64)[: self.n_texts]


class Joined:
    """Texts end to end in long integers, for `to`: a bit for each sign and one behind each text, in which its carry ends.
    All signs of a bit count, however few or many the texts; for hundreds of texts `Batch` is as fast."""

    def __init__(self, texts: list[str]):
        self.length = [len(t) for t in texts]
        self.at = [1]  # the bit before the first text begins its column, as the one behind a text does for the next
        for n in self.length:
            self.at.append(self.at[-1] + n + 1)
        size = self.at[-1] // 8 + 1
        spots: dict[str, bytearray] = {}
        for t, at in zip(texts, self.at):
            for k, c in enumerate(t, at):
                if c not in spots:
                    spots[c] = bytearray(size)
                spots[c][k >> 3] |= 1 << (k & 7)
        self.where = {c: int.from_bytes(b, "little") for c, b in spots.items()}
        self.behind = 0
        for at in self.at:
            self.behind |= 1 << (at - 1)

    def to(self, text: str, first: int, last: int) -> list[int]:
        """The edit distance of `text` to each text from `first` to `last`, the latter left out: a column of the table at a
        time, as two bit vectors of the places where it rises and falls."""
        low, size = self.at[first] - 1, self.at[last] - self.at[first] + 1
        ones = (1 << size) - 1
        full = ones ^ self.behind >> low & ones
        where = {c: self.where.get(c, 0) >> low & full for c in set(text)}
        rise, fall = full, 0
        for c in text:
            same = where[c] | fall
            diagonal = ((same & rise) + rise ^ rise | same) & full
            up = (fall | (diagonal | rise) ^ ones) << 1
            down = (rise & diagonal) << 1
            rise = ((diagonal | up) ^ ones | down) & full
            fall = up & diagonal
        out = []
        for n, at in zip(self.length[first:last], self.at[first:last]):
            own = (1 << n) - 1
            out.append(len(text) + (rise >> at - low & own).bit_count() - (fall >> at - low & own).bit_count())
        return out
