"""Edit distances of many pairs of strings at once, in numpy lanes."""

from __future__ import annotations

import numpy as np

#: Cells of state that one pass holds.
CELLS = 1 << 20
#: Longest string of ``word_distances``: a column of its table is one machine word.
WORD = 64
_ONE = np.uint64(1)


def _windows(strings: list[str], wide: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """All strings one after the other as 8-byte windows, one from each character on; where each begins; characters in a window."""
    raw = "".join(strings).encode("utf-32-le" if wide else "latin-1", "surrogatepass" if wide else "strict")
    size, step = (4, 2) if wide else (1, 8)
    n = len(raw) // size
    raw += b"\0" * 16
    out = np.empty(n + 1, np.uint64)
    for k in range(step):
        part = out[k::step]
        part[:] = np.frombuffer(raw, "<u8", len(part), k * size)
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    return out, np.cumsum(lengths) - lengths, step


def _slide(x: np.ndarray, y: np.ndarray, left: np.ndarray, wx: np.ndarray, wy: np.ndarray, step: int) -> np.ndarray:
    """Equal characters from places ``x`` and ``y`` on, ``left`` at most: whole windows while they agree, then the one that differs."""
    out = np.zeros(len(x), np.int64)
    at = np.flatnonzero(left > 0)
    bits = 64 // step
    while len(at):
        done = out[at]
        differ = wx[x[at] + done] ^ wy[y[at] + done]
        same = differ == 0
        low = differ & (~differ + _ONE)
        low[same] = 1
        more = np.where(same, step, np.log2(low.astype(np.float64)).astype(np.int64) // bits)
        out[at] = np.minimum(done + more, left[at])
        at = at[same & (done + step < left[at])]
    return out


def diagonal_distances(xs: list[str], ys: list[str], k: int) -> np.ndarray:
    """Unit-cost edit distance of each ``xs[p]`` and ``ys[p]``, -1 where it exceeds ``k``.

    For each number of edits the furthest place on each diagonal that can still end within ``k`` is known (Ukkonen): all such diagonals of all
    pairs take a step together, and then slide over what agrees, eight bytes at a time. So the work is some ``k`` * ``k`` / 2 steps a pair and
    one for eight characters of what is equal, whatever the lengths.
    """
    result = np.full(len(xs), -1, np.int32)
    pairs = max(1, CELLS // (2 * k + 3))
    lo = 0
    while lo < len(xs):
        hi, letters = lo, 0
        while hi < len(xs) and hi - lo < pairs and (hi == lo or letters < CELLS):
            letters += len(xs[hi]) + len(ys[hi])
            hi += 1
        result[lo:hi] = _diagonals(xs[lo:hi], ys[lo:hi], k)
        lo = hi
    return result


def _diagonals(xs: list[str], ys: list[str], k: int) -> np.ndarray:
    wide = not ("".join(xs).isascii() and "".join(ys).isascii()) and max(map(max, filter(None, [*xs, *ys])), default="") > "\xff"
    wx, ox, step = _windows(xs, wide)
    wy, oy, _ = _windows(ys, wide)
    nx, ny = (np.fromiter(map(len, s), np.int64, len(s)) for s in (xs, ys))
    goal = ny - nx
    result = np.full(len(xs), -1, np.int32)
    live = np.flatnonzero(np.abs(goal) <= k)
    # furthest[p, d + k + 1]: characters of x done on diagonal d (places in y less those in x); -2: not reached.
    furthest = np.full((len(live), 2 * k + 3), -2, np.int64)
    for e in range(k + 1):
        low, high = np.maximum(-e, goal[live] - (k - e)), np.minimum(e, goal[live] + (k - e))
        count = np.maximum(high - low + 1, 0)
        row = np.repeat(np.arange(len(live)), count)
        d = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        p, cell = live[row], d + k + 1
        if e:
            at = np.maximum(np.maximum(furthest[row, cell] + 1, furthest[row, cell + 1] + 1), furthest[row, cell - 1])
            at = np.minimum(np.minimum(at, nx[p]), ny[p] - d)
        else:
            at = np.zeros(len(row), np.int64)
        ok = (at >= 0) & (at + d >= 0)
        row, d, p, cell, at = row[ok], d[ok], p[ok], cell[ok], at[ok]
        at = at + _slide(ox[p] + at, oy[p] + at + d, np.minimum(nx[p] - at, ny[p] - at - d), wx, wy, step)
        furthest[:] = -2  # lanes that can no longer end within the threshold are given up
        furthest[row, cell] = at
        arrived = furthest[np.arange(len(live)), goal[live] + k + 1] >= nx[live]
        if arrived.any():
            result[live[arrived]] = e
            live, furthest = live[~arrived], furthest[~arrived]
        if not len(live):
            break
    return result


def word_distances(xs: list[str], ys: list[str]) -> np.ndarray:
    """Edit distances of all pairs of a string of ``xs`` (``WORD`` characters at most) and one of ``ys`` (of any length), as a matrix.

    A column of the table is the bits of one word, of all pairs at once (Myers, in Hyyrö's form): a step for each character of ``ys``.
    """
    known = sorted(set("".join(xs)))
    code = {c: k + 1 for k, c in enumerate(known)}
    n = np.fromiter(map(len, xs), np.int64, len(xs))
    m = np.fromiter(map(len, ys), np.int64, len(ys))
    # Words no wider than the strings: more of them go through at a time.
    word = next(t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if n.max(initial=0) <= bits)
    one, full = word(1), word(np.iinfo(word).max)
    places = np.zeros((len(xs), len(known) + 1), word)
    for i, s in enumerate(xs):
        for j, c in enumerate(s):
            places[i, code[c]] |= one << word(j)
    longest = int(m.max(initial=0))
    letters = np.zeros((len(ys), longest), np.int64)
    for i, s in enumerate(ys):
        letters[i, : len(s)] = [code.get(c, 0) for c in s]
    high = (one << np.maximum(n - 1, 0).astype(word))[:, None]
    more, less = np.full((len(xs), len(ys)), full), np.zeros((len(xs), len(ys)), word)
    score = np.repeat(n[:, None], len(ys), 1).astype(np.int32)
    out = np.where(m[None, :] == 0, n[:, None], 0).astype(np.int32)
    for j in range(longest):
        same = places.take(letters[:, j], axis=1)
        down = same | less
        across = (((same & more) + more) ^ more) | same
        up = less | ~(across | more)
        fall = more & across
        score += (up & high) != 0
        score -= (fall & high) != 0
        up = (up << one) | one
        more = (fall << one) | ~(down | up)
        less = up & down
        ended = np.flatnonzero(m == j + 1)
        if len(ended):
            out[:, ended] = score[:, ended]
    return np.where(n[:, None] == 0, m[None, :], out).astype(np.int32)


#: Words that each array of ``sliced_distances`` has, 64 pairs in a word.
SLICE = 8192
_ALL = 0xFFFFFFFFFFFFFFFF


class Sliced:
    """Strings of one length as bits: for each place and letter which of the strings have it there, 64 strings in a word. ``shared``: letters
    that all of them begin with."""

    def __init__(self, strings: list[str]):
        self.strings, self.n, self.size = strings, len(strings), len(strings[0])
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(self.n, self.size)
        self.letters, at = np.unique(codes, return_inverse=True)
        self.codes = codes
        at = at.reshape(codes.shape)
        differ = (codes != codes[0]).any(0)
        self.shared = int(differ.argmax()) if differ.any() else self.size
        self.first = at[0, : self.shared].tolist()
        words = -(-self.n // 64)
        self.planes = []
        for j in range(self.size):
            if j < self.shared:  # all or none of them
                plane = np.zeros((len(self.letters) + 1, 1), np.uint64)
                plane[at[0, j]] = _ALL
            else:
                bits = np.zeros((len(self.letters) + 1, words * 64), np.uint8)
                bits[at[:, j], np.arange(self.n)] = 1
                plane = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            self.planes.append(plane)

    def places_of(self, other: Sliced) -> np.ndarray:
        """The row of a plane that each letter of ``other`` stands for; the last one, which is empty, for letters that no string here has."""
        at = np.searchsorted(self.letters, other.codes)
        at[at == len(self.letters)] = 0
        return np.where(self.letters[at] == other.codes, at, len(self.letters)) if len(self.letters) else np.zeros(other.codes.shape, np.int64)


def sliced_distances(xs: Sliced, ys: Sliced, k: int) -> np.ndarray:
    """Edit distances of all pairs of strings of ``xs``, of one length, and ``ys``, of one length, as a matrix of bytes; ``k`` + 1 where they exceed ``k``.

    Differences between neighbouring cells of the table are bits (Myers), here of 64 pairs in a word, so a cell is eleven operations on words for all
    pairs. Only diagonals that a path of ``k`` edits can reach are filled. Cells within the letters that all strings of a side begin with are
    found once for that side.
    """
    n, m = xs.size, ys.size
    out = np.full((xs.n, ys.n), k + 1, np.uint8)
    shift = m - n
    if abs(shift) > k:
        return out
    spare = (k - abs(shift)) // 2
    low, high = min(0, shift) - spare, max(0, shift) + spare
    at = ys.places_of(xs)
    step = max(1, SLICE // -(-ys.n // 64))
    for begin in range(0, xs.n, step):
        end = min(begin + step, xs.n)
        _slice(at[begin:end], xs.shared, ys, shift, low, high, k, out[begin:end])
    return out


def _slice(at: np.ndarray, shared: int, ys: Sliced, shift: int, low: int, high: int, k: int, out: np.ndarray) -> None:
    n, m = at.shape[1], ys.size
    full = (len(at), -(-ys.n // 64))
    large = full[0] * full[1] > 1024  # smaller arrays are as well made anew
    pool: list[np.ndarray] = []
    take = lambda: pool.pop() if pool else np.empty(full, np.uint64)
    own = lambda x: isinstance(x, np.ndarray) and x.shape == full
    # Whether a cell is more, and less, than the one to its left (a column's last) and than the one above it: a number where that is so of all pairs.
    across_more, across_less = [_ALL] * (m + 1), [0] * (m + 1)
    count: list[np.ndarray | int] = []
    firsts = [int(x) for x in at[0, :shared]]
    cells = 0
    for i in range(1, n + 1):
        down_more, down_less = _ALL, 0
        for j in range(max(1, i + low), min(m, i + high) + 1):
            plane = ys.planes[j - 1]
            more, less = across_more[j], across_less[j]
            every = large and i > shared and plane.shape[1] == full[1]
            if i <= shared and j <= ys.shared:
                same = (_ALL if firsts[i - 1] == ys.first[j - 1] else 0) | down_less | less
                up_less, up_more = more & same, less | ((same | more) ^ _ALL)
                across_less[j], across_more[j] = down_more & same, down_less | ((same | down_more) ^ _ALL)
                down_more, down_less = up_more, up_less
            elif not every:
                same = plane[firsts[i - 1]][None, :] if i <= shared else plane.take(at[:, i - 1], axis=0)
                same = same | down_less | less
                up_less, up_more = more & same, less | ~(same | more)
                across_less[j], across_more[j] = down_more & same, down_less | ~(same | down_more)
                down_more, down_less = up_more, up_less
            else:
                same = plane.take(at[:, i - 1], axis=0, out=take(), mode="clip")
                same |= down_less
                same |= less
                up_less, up_more = np.bitwise_and(more, same, out=take()), np.bitwise_or(same, more, out=take())
                np.invert(up_more, out=up_more)
                up_more |= less
                new_less = less if own(less) else take()
                new_more = more if own(more) else take()
                np.bitwise_and(down_more, same, out=new_less)
                np.bitwise_or(same, down_more, out=new_more)
                np.invert(new_more, out=new_more)
                new_more |= down_less
                across_less[j], across_more[j] = new_less, new_more
                pool.extend(filter(own, (down_more, down_less)))
                down_more, down_less = up_more, up_less
            if j == i + shift:
                carry, cells = same ^ _ALL, cells + 1
                for b in range(len(count)):
                    count[b], carry = count[b] ^ carry, count[b] & carry
                if (cells & (cells - 1)) == 0:  # as many cells as need a bit more
                    count.append(carry)
            if every:
                pool.append(same)
        if large:
            pool.extend(filter(own, (down_more, down_less)))
        if i + low >= 1:  # the column leaves the band
            j = i + low
            if large:
                pool.extend(filter(own, (across_more[j], across_less[j])))
            across_more[j], across_less[j] = _ALL, 0
    total = np.full((1, 1), abs(shift), np.uint8)
    for b, bits in enumerate(count):
        if isinstance(bits, int):
            one = np.full((1, 1), bits & 1, np.uint8)
        elif bits.shape[1] == full[1]:
            one = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, bitorder="little")[:, : ys.n]
        else:
            one = (bits & _ONE).astype(np.uint8)
        total = total + (one << b if b else one)
    np.minimum(total, k + 1, out=out)
