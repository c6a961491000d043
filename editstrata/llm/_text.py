"""Word hashing over whole Arrow columns, in numpy, with memory bounded by a piece of text.

A word is a maximal run of bytes other than space and U+0009 to U+000D; A-Z are
lower-cased on request. `bytes.split()` cuts at the same six characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; longer single texts are cut between words.
PIECE = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**64, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Rows whose text is copied at once.
_ROWS = 1024
#: As _SPACE, with all other ASCII characters but letters and digits.
_MARK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 4096)
        _powers[:] = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def _words(data: np.ndarray, bounds: np.ndarray, lower: bool, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of `data`, the positions of their first bytes and after their last, and running sums for parts of words; no word spans one of `bounds`."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, np.zeros(1, np.uint64)
    b = _LOWER[data] if lower else data
    space = between[b]
    cut = np.zeros(n + 1, dtype=bool)
    cut[bounds] = True
    cut[0] = cut[n] = True
    cut[1:] |= space
    before = cut[:-1].copy()
    before[1:] |= space[:-1]
    start = np.flatnonzero(before & ~space)
    after = cut[1:].copy()
    after[:-1] |= space[1:]
    end = np.flatnonzero(after & ~space) + 1
    power, inverse = _tables(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[b] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), start, end, total


def _hash_piece(data: np.ndarray, bounds: np.ndarray, lower: bool, between: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of `data` and their first bytes' positions.

    prefixes: also the first so many bytes of longer words, after all words.
    """
    hashes, start, end, total = _words(data, bounds, lower, between)
    if not prefixes or not len(data):
        return hashes, start
    inverse = _tables(len(data))[1]
    starts, found = [start], [hashes]
    for k in prefixes:
        longer = start[end - start > k]
        starts.append(longer)
        found.append(mix((total[longer + k] - total[longer]) * inverse[longer] + np.uint64(k << 32)))
    return np.concatenate(found), np.concatenate(starts)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """One long text in parts that end between words."""
    at = 0
    while at < len(data):
        to = min(len(data), at + PIECE)
        while to < len(data) and not _SPACE[data[to]]:
            ahead = np.flatnonzero(_SPACE[data[to : to + PIECE]])
            to = to + int(ahead[0]) if len(ahead) else min(len(data), to + PIECE)
        yield data[at:to]
        at = to


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buf = column.buffers()[2]
    return np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8), offsets


def _blocks(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Blocks of rows with their first row; memory that a block took is given back."""
    for at in range(0, len(column), _ROWS):
        yield at, column.slice(at, _ROWS)
    pa.default_memory_pool().release_unused()


def hashed_stems(column: pa.Array, prefixes: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, number of rows, hashes of lower-cased words and of their prefixes, each hash's row in the slice)."""
    for at, block in _blocks(column):
        for row, *rest in _hashed_stems(block, prefixes):
            yield at + row, *rest


def _hashed_stems(column: pa.Array, prefixes: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = _flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        span = data[offsets[row] : offsets[to]]
        if len(span) > PIECE:  # one long text
            hashes = np.concatenate([_hash_piece(p, np.empty(0, np.int64), True, _MARK, prefixes)[0] for p in _pieces(span)])
            owner = np.zeros(len(hashes), np.int64)
        else:
            local = offsets[row : to + 1] - offsets[row]
            hashes, start = _hash_piece(span, local, True, _MARK, prefixes)
            owner = np.searchsorted(local, start, side="right") - 1
        yield row, to - row, hashes, owner
        row = to


def hashed_words(column: pa.Array, *, lower: bool = True, marks: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, word hashes of the slice, number of words of each row). Null texts have none.

    marks: ASCII punctuation also ends a word and belongs to none.
    """
    for at, block in _blocks(column):
        for row, *rest in _hashed_words(block, lower, _MARK if marks else _SPACE):
            yield at + row, *rest


def _hashed_words(column: pa.Array, lower: bool, between: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = _flat(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        span = data[offsets[row] : offsets[to]]
        if len(span) > PIECE:  # one long text
            hashes = np.concatenate([_hash_piece(p, np.empty(0, np.int64), lower, between)[0] for p in _pieces(span)])
            yield row, hashes, np.array([len(hashes)])
        else:
            local = offsets[row : to + 1] - offsets[row]
            hashes, start = _hash_piece(span, local, lower, between)
            yield row, hashes, np.diff(np.searchsorted(start, local))
        row = to


def placed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of rows: (first row, bytes of the slice, where each row begins and the last ends, word hashes, first and end positions of the words). Case is kept."""
    for at, block in _blocks(column):
        data, offsets = _flat(block)
        row, rows = 0, len(offsets) - 1
        while row < rows:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
            span = data[offsets[row] : offsets[to]]
            if len(span) > PIECE:  # one long text
                base, parts = 0, []
                for piece in _pieces(span):
                    hashes, start, end, _ = _words(piece, np.empty(0, np.int64), False, _SPACE)
                    parts.append((hashes, start + base, end + base))
                    base += len(piece)
                yield at + row, span, np.array([0, len(span)]), *(np.concatenate(x) for x in zip(*parts, strict=True))
            else:
                local = offsets[row : to + 1] - offsets[row]
                yield at + row, span, local, *_words(span, local, False, _SPACE)[:3]
            row = to


def shingle_hashes(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than `size` make one shingle, none make none."""
    n = len(words)
    if n >= size:
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[k : n - size + 1 + k]
        h = mix(h)
    ends = np.cumsum(counts)
    out = []
    for to, c in zip(ends.tolist(), counts.tolist(), strict=True):
        if c >= size:
            out.append(np.unique(h[to - c : to - size + 1]))
        elif c:
            whole = np.uint64(c)
            for w in words[to - c : to]:
                whole = mix(np.array([whole ^ w]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def exact_shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, for confirming what hashes suggest."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size)), strict=False))
