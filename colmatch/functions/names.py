"""String measures on names and single values, in plain Python.

They run on names (metadata) or inside Arrow batches on distinct value pairs.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

# Words that stand for one another in suggestions.
SYNONYMS = {"supplier": "vendor", "item": "product", "qty": "quantity", "ref": "reference", "txn": "transaction", "key": "id"}


def _alnum(ch: str) -> bool:
    return ch.isalpha() or unicodedata.category(ch)[0] == "N"


def normalize_name(name: str) -> str:
    """Letters and digits only, lowered one by one."""
    return "".join(c.lower() for c in name if _alnum(c))


def tokenize_name(name: str) -> set[str]:
    words = "".join(c.lower() if _alnum(c) else " " for c in name).split()
    return {SYNONYMS.get(w, w) for w in words}


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def damerau_levenshtein(a: str, b: str) -> int:
    """Unrestricted: a transposed pair may be edited between (CA to ABC takes 2)."""
    seen: dict[str, int] = {}
    n, m = len(a), len(b)
    far = n + m
    d = [[far] * (m + 2) for _ in range(n + 2)]
    for i in range(n + 1):
        d[i + 1][1] = i
    for j in range(m + 1):
        d[1][j + 1] = j
    for i in range(1, n + 1):
        match_col = 0
        for j in range(1, m + 1):
            row = seen.get(b[j - 1], 0)
            col = match_col
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match_col = j
            d[i + 1][j + 1] = min(d[i][j] + cost, d[i + 1][j] + 1, d[i][j + 1] + 1, d[row][col] + (i - row - 1) + 1 + (j - col - 1))
        seen[a[i - 1]] = i
    return d[n + 1][m + 1]


def jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str, boost_from: float = 0.7) -> float:
    base = jaro(a, b)
    if base <= boost_from:
        return base
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return min(1.0, base + 0.1 * same * (1 - base))


def levenshtein_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - levenshtein(a, b) / longest


def damerau_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - damerau_levenshtein(a, b) / longest


def hamming_similarity(a: str, b: str) -> float:
    """Equal places over the longer length; what one string lacks counts as unequal."""
    longest = max(len(a), len(b))
    return 1.0 if not longest else sum(x == y for x, y in zip(a, b)) / longest


DISTANCES = {
    "levenshtein": levenshtein_similarity, "damerau_levenshtein": damerau_similarity, "hamming": hamming_similarity,
    "jaro": jaro, "jaro_winkler": jaro_winkler, "exact": lambda a, b: float(a == b),
}


def name_score(a: str, b: str) -> float:
    """Of suggestions: 1 for equal bare names, else the better of Jaro-Winkler and shared words."""
    x, y = normalize_name(a), normalize_name(b)
    if x == y:
        return 1.0
    p, q = tokenize_name(a), tokenize_name(b)
    words = len(p & q) / min(len(p), len(q)) if p and q else 0.0
    return max(jaro_winkler(x, y), words)


def _subsequence_score(pattern: str, text: str, match: int = 16, first: int = 8, run: int = 8, gap_open: int = 3, gap_more: int = 1) -> int | None:
    """The best score of ``pattern`` as a subsequence of ``text``; None if it is none."""
    none = -(10 ** 9)
    best = [none] * (len(text) + 1)
    best_any = 0
    for i, p in enumerate(pattern):
        row = [none] * (len(text) + 1)
        far = none  # the best of earlier ends, with the gap to here paid
        for j, t in enumerate(text):
            if i and j:
                far = max(far - gap_more, best[j - 1] - gap_open)
            if p == t:
                if i == 0:
                    row[j + 1] = match + (first if j == 0 else 0)
                else:
                    row[j + 1] = max(best[j] + match + run if best[j] > none // 2 else none, far + match if far > none // 2 else none)
        best = row
        best_any = max(best)
        if best_any <= none // 2:
            return None
    return best_any if pattern else None


def abbreviation_score(a: str, b: str) -> float:
    """How well the shorter name abbreviates the longer: its subsequence score over that of itself."""
    x, y = sorted((normalize_name(a), normalize_name(b)), key=lambda s: (len(s), s))
    if not x:
        return 0.0
    found, most = _subsequence_score(x, y), _subsequence_score(x, x)
    return 0.0 if found is None or not most else min(1.0, max(0.0, found / most))


_TOKEN = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|\d+")
_TOKEN_ASCII = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+")


@lru_cache(maxsize=65_536)
def tokens(name: str) -> tuple[str, ...]:
    """Camel, Pascal, acronym and digit parts in lower case, each once, by first place."""
    return tuple(dict.fromkeys(t.lower() for t in _TOKEN.findall(name)))


def split_words(name: str) -> list[str]:
    """Parts of a label with their case kept; the whole name if it has none."""
    return _TOKEN_ASCII.findall(name) or [name]


def is_abbreviation(a: str, b: str) -> bool:
    if a == b:
        return True
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) < 2 or short[0] != long[0] or len(short) / len(long) < 0.3:
        return False
    rest = iter(long)
    return long.startswith(short) or all(c in rest for c in short)


def tokens_similarity(a: str, b: str) -> float:
    """Dice over tokens; each of the shorter list takes the first free one that equals or abbreviates it."""
    p, q = list(tokens(a)), list(tokens(b))
    if not p or not q:
        return 0.0
    if len(p) > len(q):
        p, q = q, p
    free, met = list(q), 0
    for t in p:
        hit = next((u for u in free if is_abbreviation(t, u)), None)
        if hit is not None:
            free.remove(hit)
            met += 1
    return 2 * met / (len(p) + len(q))


def trigrams(text: str) -> Counter:
    s = text.lower()
    return Counter([s[i:i + 3] for i in range(len(s) - 2)] if len(s) >= 3 else [s] if s else [])


def trigram_similarity(a: str, b: str) -> float:
    p, q = trigrams(a), trigrams(b)
    if not p and not q:
        return 1.0
    if not p or not q:
        return 0.0
    return 2 * sum((p & q).values()) / (sum(p.values()) + sum(q.values()))


def flooding_word_similarity(a: str, b: str) -> float:
    """(common prefix + common suffix of the rest) * shorter / longer squared."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    shorter, longer = min(len(a), len(b)), max(len(a), len(b))
    head = 0
    while head < shorter and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < shorter - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return (head + tail) * shorter / longer ** 2


def prefix_suffix(a: str, b: str, idf: dict[str, float] | None = None) -> float:
    """The mean, over the words of both labels, of their best partner; weighted by IDF if given."""
    p, q = split_words(a), split_words(b)
    weight = lambda w: 1.0 if idf is None else idf.get(w.lower(), 1.0)
    pooled = [(weight(w), max((flooding_word_similarity(w, v) for v in other), default=0.0)) for mine, other in ((p, q), (q, p)) for w in mine]
    total = sum(w for w, _ in pooled)
    return sum(w * s for w, s in pooled) / total if total > 0 else 0.0
