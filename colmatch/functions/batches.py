"""Similarities of many pairs of texts at once, equal to those of ``names``, and the search for a similar text.

They run inside Arrow batches on distinct values, none of them empty.
"""

from __future__ import annotations

import numpy as np

from colmatch.functions.names import damerau_levenshtein

_BUCKETS, _DEPTH = 64, 63
_ROWS, _PAIRS, _CELLS = 1024, 65_536, 1_000_000


def _levenshtein(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The distance tables of all pairs, a row at a time."""
    at = np.arange(b.shape[1] + 1, dtype=np.int32)
    row = np.repeat(at[None, :], len(a), axis=0)
    out = np.zeros(len(a), dtype=np.int64)
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (b != a[:, i, None]), out=new[:, 1:])
        new -= at  # so that an insertion costs nothing along the row
        np.minimum.accumulate(new, axis=1, out=new)
        new += at
        row, last = new, np.flatnonzero(n == i + 1)
        out[last] = row[last, m[last]]
    return out


def _levenshtein_similarity(a, n, b, m):
    return 1 - _levenshtein(a, n, b, m) / np.maximum(n, m)


def _hamming_similarity(a, n, b, m):
    k = min(a.shape[1], b.shape[1])
    return ((a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None])).sum(axis=1) / np.maximum(n, m)


def _firsts(codes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The kept characters of each row, moved to its front in their order."""
    return np.take_along_axis(codes, np.argsort(~kept, axis=1, kind="stable"), axis=1)


def _jaro(a, n, b, m):
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)[:, None]
    at, inside = np.arange(b.shape[1]), np.arange(b.shape[1]) < m[:, None]
    free, taken, every = inside.copy(), np.zeros(a.shape, dtype=bool), np.arange(len(a))
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i, None]) & (np.abs(at - i) <= reach)
        first = fits.argmax(axis=1)
        taken[:, i] = fits[every, first] & (i < n)
        free[every[taken[:, i]], first[taken[:, i]]] = False
    common = taken.sum(axis=1)
    k = int(common.max(initial=0))
    swaps = ((_firsts(a, taken)[:, :k] != _firsts(b, inside & ~free)[:, :k]) & (np.arange(k) < common[:, None])).sum(axis=1) // 2
    return np.where(common > 0, (common / n + common / m + (common - swaps) / np.maximum(common, 1)) / 3, 0.0)


def _jaro_winkler(a, n, b, m):
    base, k = _jaro(a, n, b, m), min(4, a.shape[1], b.shape[1])
    same = np.logical_and.accumulate((a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(n, m)[:, None]), axis=1).sum(axis=1)
    return np.where(base <= 0.7, base, np.minimum(1.0, base + 0.1 * same * (1 - base)))


def _damerau_similarity(a, n, b, m):
    """A transposition is two other edits, so pairs of distance 0 or 1 have the plain one; others are walked."""
    far, of = _levenshtein(a, n, b, m), lambda codes, k: codes[:k].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for i in np.flatnonzero(far > 1):
        far[i] = damerau_levenshtein(of(a[i], n[i]), of(b[i], m[i]))
    return 1 - far / np.maximum(n, m)


MEASURES = {"levenshtein": _levenshtein_similarity, "hamming": _hamming_similarity, "damerau_levenshtein": _damerau_similarity, "jaro": _jaro, "jaro_winkler": _jaro_winkler}


def _codes(texts: list[str]) -> np.ndarray:
    return np.array(texts, dtype=np.str_).view(np.uint32).reshape(len(texts), -1)


def _lengths(texts: np.ndarray) -> np.ndarray:
    return np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))


def similarities(distance: str, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Of the pairs xs[k], ys[k] (arrays of str); pairs of like lengths are done together."""
    n, m, out = _lengths(xs), _lengths(ys), np.empty(len(xs))
    todo = [np.argsort(n + m, kind="stable")] if len(xs) else []
    while todo:
        at = todo.pop()
        if len(at) > 1 and len(at) * int(n[at].max() + m[at].max()) > _CELLS:
            todo += [at[:len(at) // 2], at[len(at) // 2:]]
        else:
            out[at] = MEASURES[distance](_codes(xs[at].tolist()), n[at], _codes(ys[at].tolist()), m[at])
    return out


def _near(distance: str, cutoff: float, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which pairs are similar enough. A transposition is at most two plain edits, so plain distances decide most of Damerau's."""
    if distance != "damerau_levenshtein":
        return similarities(distance, xs, ys) >= cutoff
    longest = np.maximum(_lengths(xs), _lengths(ys))
    plain = similarities("levenshtein", xs, ys)
    near = plain >= cutoff
    edits = np.rint((1 - plain) * longest)
    open_ = np.flatnonzero(~near & (1 - np.ceil(edits / 2) / longest >= cutoff))
    near[open_] = similarities(distance, xs[open_], ys[open_]) >= cutoff
    return near


def _bags(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How often the characters of each bucket occur in each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4") % _BUCKETS
    return np.bincount(np.repeat(np.arange(len(texts)) * _BUCKETS, lengths) + codes, minlength=len(texts) * _BUCKETS).reshape(-1, _BUCKETS)


def _most_similar(distance: str, p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The most that ``distance`` can give texts of bags p and q, lengths n and m: a row for each of p.

    Two texts share no more characters than the smaller counts of the buckets; their sums are
    products of rows that say whether a bucket has a first, a second, ... character.
    """
    top = np.minimum(p.max(axis=0), q.max(axis=0))
    deep = np.minimum(top, _DEPTH)
    bucket = np.repeat(np.arange(_BUCKETS), deep)
    nth = np.arange(len(bucket)) - np.repeat(np.cumsum(deep) - deep, deep) + 1
    common = (p[:, bucket] >= nth).astype(np.float32) @ (q[:, bucket] >= nth).astype(np.float32).T
    if (top > deep).any():  # whatever a text has beyond, the other may have too
        common += np.maximum(p - _DEPTH, 0).sum(axis=1, dtype=np.float32)[:, None]
    n, m = n.astype(np.float32)[:, None], m.astype(np.float32)
    if distance not in ("jaro", "jaro_winkler"):
        return common / np.maximum(n, m)
    jaro = np.where(common > 0, (common / n + common / m + 1) / 3, np.float32(0))
    return jaro if distance == "jaro" else np.where(jaro > 0.7 - 1e-5, jaro + np.float32(0.4) * (1 - jaro), jaro)


def _tried(distance: str, cutoff: float, xs: np.ndarray, ys: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of xs have a partner in ys: the most promising one is tried first, then eight, then all."""
    least = cutoff - 1e-5  # the bounds are of single precision
    got = np.zeros(len(xs), dtype=bool)
    left = np.flatnonzero(most.max(axis=1) >= least)
    for tries in (1, 8, len(ys)):
        rest = most[left]
        if tries < len(ys):
            c = np.argpartition(-rest, tries - 1, axis=1)[:, :tries].ravel() if tries > 1 else rest.argmax(axis=1)
            r = np.repeat(np.arange(len(left)), tries)
            passed = rest[r, c] >= least
            r, c = r[passed], c[passed]
        else:
            r, c = np.nonzero(rest >= least)
        r = left[r]
        for k in range(0, len(r), _PAIRS):
            i, j = r[k:k + _PAIRS], c[k:k + _PAIRS]
            if k:
                i, j = i[~got[i]], j[~got[i]]
            got[i[_near(distance, cutoff, xs[i], ys[j])]] = True
        most[r, c] = -1
        left = left[~got[left]]
    return got


def partnered(distance: str, cutoff: float, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Which of the texts xs have one among ys that is at least as similar as the cutoff, which is above 0.

    Growing parts of ys are searched; a text leaves with its first partner. Pairs that
    lengths and characters in common exclude are not compared.
    """
    found = np.zeros(len(xs), dtype=bool)
    if not len(xs) or not len(ys):
        return found
    n, m = _lengths(xs), _lengths(ys)
    p, q = _bags(xs, n), _bags(ys, m)
    begin, size, left = 0, 256, np.arange(len(xs))
    while begin < len(ys) and len(left):
        part = slice(begin, begin + size)
        for k in range(0, len(left), _ROWS):
            at = left[k:k + _ROWS]
            found[at] = _tried(distance, cutoff, xs[at], ys[part], _most_similar(distance, p[at], n[at], q[part], m[part]))
        begin, size, left = begin + size, min(4 * size, 4096), left[~found[left]]
    return found
