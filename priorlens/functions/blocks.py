"""Longest common blocks of two texts, recursively, in memory that is linear in the texts.

The longest block that both texts share is taken (of equally long ones the first in the left text, then in the right one), then
the same on its left and on its right. A window of the left text, one longer than the best block so far, is looked for in the
right one: if it is there, the block is extended and the window grows; if not, its longest end that is there tells how far the
window can move on. Texts with many repeats can hold that up, so its work is bounded. Beyond the bound the
length is found by bisection: a length is reached if a window of the left text has the hash of a window of the right one.
Hashes of all windows of a length come from prefix sums modulo two primes, by array operations, and what is found is compared
as text, so a chance hit is found out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many cells windows may take any work on a pair of ranges.
CELLS = 1 << 12
#: Beyond, so many characters may be passed over for each character of both ranges; and what one search costs in characters.
PASSED, SEARCH = 1000, 100
PRIMES = (2_147_483_629, 2_147_483_587)


def _powers(base: int, n: int, p: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base % p
    while len(out) < n:
        out = np.concatenate((out, out * np.uint64(step) % np.uint64(p)))
        step = step * step % p
    return out[:n]


class _Hashes:
    def __init__(self, text: np.ndarray, powers: list[np.ndarray]):
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * w[: len(text)] % np.uint64(p)))) for w, p in zip(powers, PRIMES, strict=True)]
        self.powers = powers

    def windows(self, start: int, end: int, n: int) -> np.ndarray:
        """Hashes of the windows of length n within start:end, shifted to one common power."""
        out, top = None, len(self.powers[0]) - 1
        for s, w, p in zip(self.sums, self.powers, PRIMES, strict=True):
            p = np.uint64(p)
            h = (s[start + n : end + 1] - s[start : end - n + 1]) % p * w[top - start : (top - (end - n + 1)) or None : -1][: end - n + 1 - start] % p
            out = h if out is None else (out << np.uint64(32)) | h
        return out


class _Pair:
    def __init__(self, a: str, b: str):
        self.left, self.right = a, b
        self.hashes: tuple[_Hashes, _Hashes] | None = None

    def _reach(self, i, j, ahi, bhi):
        """The number of characters that both texts share from i and j on."""
        a, b, n, step, most = self.left, self.right, 0, 16, min(ahi - i, bhi - j)
        while n < most:
            step = min(step, most - n)
            if a[i + n : i + n + step] == b[j + n : j + n + step]:
                n, step = n + step, 2 * step
            elif step == 1:
                break
            else:
                step //= 2
                most = min(most, n + 2 * step + 1)  # what differs lies within
        return n

    def _by_windows(self, alo, ahi, blo, bhi, most):
        """(length, place left, place right) of the longest block; None if that takes too much work."""
        a, find, i, best, at = self.left, self.right.find, alo, 0, (alo, blo)
        most, left = min(most, bhi - blo, ahi - alo), PASSED * (ahi - alo + bhi - blo) if (ahi - alo) * (bhi - blo) > CELLS else float("inf")
        while i + best < ahi and best < most and left > 0:
            end, j = i + best + 1, find(a[i : i + best + 1], blo, bhi)
            left -= SEARCH + (bhi - blo if j < 0 else j - blo)
            if j >= 0:
                while j >= 0:
                    best, at = best + 1 + self._reach(i + best + 1, j + best + 1, ahi, bhi), (i, j)
                    if i + best >= ahi or best >= most:
                        return best, *at
                    k, j = j, find(a[i : i + best + 1], j + 1, bhi)
                    left -= SEARCH + (bhi - k if j < 0 else j - k)
                i += 1
                continue
            # every window up to the one that begins with the longest end of this one holds what isn't there
            low, high = i + 1, end
            while low < high:
                mid = (low + high) // 2
                j = find(a[mid:end], blo, bhi)
                left -= SEARCH + (bhi - blo if j < 0 else j - blo)
                low, high = (low, mid) if j >= 0 else (mid + 1, high)
            i = low
        return (best, *at) if i + best >= ahi or best >= most else None

    def _by_hash(self, alo, ahi, blo, bhi, most):
        if self.hashes is None:
            a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (self.left, self.right))
            n = max(len(a), len(b)) + 1
            powers = [_powers(1_000_003, n, PRIMES[0]), _powers(999_983, n, PRIMES[1])]
            self.hashes = _Hashes(a, powers), _Hashes(b, powers)
        ha, hb = self.hashes

        def at(n):
            """The first place in the left text whose window is in the right one, and the first there."""
            x, y = ha.windows(alo, ahi, n), hb.windows(blo, bhi, n)
            for i in np.flatnonzero(np.isin(x, y)).tolist():
                for j in np.flatnonzero(y == x[i]).tolist():
                    if self.left[alo + i : alo + i + n] == self.right[blo + j : blo + j + n]:
                        return alo + i, blo + j
            return None

        low, high, found = 0, min(ahi - alo, bhi - blo, most), None
        while low < high:
            n = (low + high + 1) // 2 if high - low < 64 or low else min(high, 32)  # most blocks are short
            if place := at(n):
                low, found = n, place
            else:
                high = n - 1
        return (low, *found) if found else (0, alo, blo)

    def longest(self, alo, ahi, blo, bhi, most):
        """No block of these ranges is longer than ``most``."""
        return self._by_windows(alo, ahi, blo, bhi, most) or self._by_hash(alo, ahi, blo, bhi, most)


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length), rising; blocks that touch on both sides are one."""
    pair, todo, found = _Pair(a, b), [(0, len(a), 0, len(b), len(a))], []
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        n, i, j = pair.longest(alo, ahi, blo, bhi, most)
        if n:
            found.append((i, j, n))
            todo += [(alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)]
    out: list[tuple[int, int, int]] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def with_blocks(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with ``blocks`` (array of a, b, size; null if a text is null), ``matched`` (characters), ``left_fraction``,
    ``right_fraction`` (null for an empty text) and ``longest_unmatched`` (the longest stretch of the right text outside of
    blocks). Rows run in Arrow batches, one pair at a time."""
    block = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("size", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, y in zip(batch.column(left).to_pylist(), batch.column(right).to_pylist(), strict=True):
                out.append(None if x is None or y is None else [{"a": i, "b": j, "size": n} for i, j, n in matching_blocks(x, y)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(block))], names=[*batch.schema.names, "blocks"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    found = pairs.mapInArrow(run, f"{schema}, blocks array<struct<a:int,b:int,size:int>>")
    matched = F.aggregate("blocks", F.lit(0), lambda n, x: n + x["size"])
    n = F.length(right)
    gap = F.aggregate(
        "blocks", F.struct(F.lit(0).alias("end"), F.lit(0).alias("most")),
        lambda acc, x: F.struct((x["b"] + x["size"]).alias("end"), F.greatest(acc["most"], x["b"] - acc["end"]).alias("most")),
        lambda acc: F.greatest(acc["most"], n - acc["end"]),
    )
    return found.withColumns({"matched": matched, "left_fraction": F.when(F.length(left) > 0, matched / F.length(left)), "right_fraction": F.when(F.length(right) > 0, matched / F.length(right)), "longest_unmatched": gap})
