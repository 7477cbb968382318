"""A taxonomy of word senses and the Wu-Palmer similarity on it.

Loaded from WordNet database files or from rows; without one, words are compared by
their letters. Names are metadata, so a lexicon lives in plain Python.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from colmatch.functions.names import levenshtein_similarity
from colmatch.functions.types import InvalidInput


@dataclass
class Lexicon:
    """``senses``: lemma to synset ids; ``parents``: synset to hypernyms; ``nouns``: noun synsets."""

    senses: dict[str, list[int]] = field(default_factory=dict)
    parents: dict[int, list[int]] = field(default_factory=dict)
    nouns: set[int] = field(default_factory=set)

    def __post_init__(self) -> None:
        self._up: dict[int, dict[int, int]] = {}
        self._depth: dict[int, tuple[int, int]] = {}

    def ancestors(self, s: int) -> dict[int, int]:
        """Each ancestor (and itself) with its least distance."""
        if s not in self._up:
            out, edge, d = {s: 0}, [s], 0
            while edge:
                d += 1
                edge = sorted({p for x in edge for p in self.parents.get(x, ()) if p not in out})
                out.update({p: d for p in edge})
            self._up[s] = out
        return self._up[s]

    def depth(self, s: int) -> tuple[int, int]:
        """(least, greatest) distance from a root."""
        if s not in self._depth:
            up = [self.depth(p) for p in self.parents.get(s, ())]
            self._depth[s] = (1 + min(a for a, _ in up), 1 + max(b for _, b in up)) if up else (0, 0)
        return self._depth[s]

    def wu_palmer(self, x: int, y: int) -> float | None:
        """2 d / (d_x + d_y + 2 d) with d the depth of the lowest common ancestor plus 1."""
        a, b = min(x, y), max(x, y)
        up_a, up_b = self.ancestors(a), self.ancestors(b)
        common = [s for s in up_a if s in up_b]
        if not common:
            if a in self.nouns and b in self.nouns:
                return None
            d, da, db = 1, self.depth(a)[0] + 1, self.depth(b)[0] + 1
            return 2 * d / (da + db + 2 * d)
        deepest = max(self.depth(s)[0] for s in common)
        among = sorted(s for s in common if self.depth(s)[0] == deepest)
        lcs = a if a in among else among[0]
        d = self.depth(lcs)[1] + 1
        return 2 * d / (up_a[lcs] + up_b[lcs] + 2 * d)

    def similarity(self, a: str, b: str) -> float:
        """1 for equal words, else the best pair of senses, else by letters."""
        if a == b:
            return 1.0
        p, q = self.senses.get(a), self.senses.get(b)
        if not p or not q:
            return levenshtein_similarity(a, b)
        found = [v for x in p for y in q if (v := self.wu_palmer(x, y)) is not None]
        return max(found) if found else levenshtein_similarity(a, b)


def from_rows(rows: list[tuple[str, int, list[int]]]) -> Lexicon:
    """(lemma, noun synset, hypernym synsets)."""
    lex = Lexicon()
    for lemma, s, up in rows:
        lex.senses.setdefault(lemma, []).append(s)
        lex.parents[s] = up
        lex.nouns.add(s)
    return lex


def from_wordnet(folder: str) -> Lexicon:
    """From the data.noun, data.verb, data.adj and data.adv files of a WordNet database."""
    lex, found = Lexicon(), False
    for place, part in enumerate(("noun", "verb", "adj", "adv")):
        path = os.path.join(folder, f"data.{part}")
        if not os.path.exists(path):
            continue
        found = True
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.startswith("  "):
                    continue
                cells = line.split("|")[0].split()
                key = int(cells[0]) * 4 + place
                count = int(cells[3], 16)
                words = [cells[4 + 2 * i].split("(")[0].lower() for i in range(count)]
                at = 4 + 2 * count
                ups = [int(cells[at + 2 + 4 * i]) * 4 + place for i in range(int(cells[at])) if cells[at + 1 + 4 * i] in ("@", "@i")]
                lex.parents[key] = ups
                if part == "noun":
                    lex.nouns.add(key)
                for w in words:
                    lex.senses.setdefault(w, []).append(key)
    if not found:
        raise InvalidInput(f"{folder}: no WordNet database files")
    return lex
