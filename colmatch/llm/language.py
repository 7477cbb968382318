"""The language of every document and of every stretch of a mixed one.

Multilingual mixture inference. Character n-grams of clean sample sentences (a
small table of fixed size) give each sentence of a document a likelihood under
each language. Expectation-maximisation estimates the document's proportions of
languages; a language stays in the document's set only if leaving it out costs
more log-likelihood than the penalty. Sentences take the language of the highest
posterior within the set, and successive sentences of one language are a stretch.
A stretch's confidence is its language's probability under a temperature that is
fitted to held-out sample sentences and their first words.

Only the sample table is held by the driver; documents stay in their rows, whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colmatch.plans.shared import spread

# How labels name the languages (ISO 639-1, 639-2, English and own names).
LABELS = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa esp spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "ja": "ja jpn jp japanese 日本語 nihongo",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "sv": "sv swe swedish svenska",
}
_BY_LABEL = {name: code for code, names in LABELS.items() for name in names.split()}
_CP1252 = {ch: bytes([b]) for b in range(0x80, 0xA0) if (ch := bytes([b]).decode("cp1252", "ignore"))}
_BROKEN = re.compile("[Â-ô][\u0080-¿" + "".join(_CP1252) + "]+")
_BREAKS = re.compile("\r\n|[\n\r  \x0b\x0c]")
_ENDS = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|(?<=[。！？])\s*")
_LINK = re.compile(r"\S*://\S+|\bwww\.\S+")
_QUOTED = re.compile("\"[^\"]*\"|«[^»]*»|“[^”]*”|„[^“”]*[“”]|`[^`]*`|「[^」]*」")
_LATIN = "A-Za-zÀ-ɏ"
# runs of Latin letters and digits with what may join them, or letters of another script
_RUN = re.compile(rf"[{_LATIN}0-9_]+(?:[.\-'’][{_LATIN}0-9_]+)*|[Ͱ-῿Ⰰ-⿿々〆ぁ-ヺー-㆏ㆠ-퟿豈-﷿ﹰ-ﻼｦ-ￜ]+")
_CAMEL = re.compile("[a-zß-ÿ].*[A-Z]")
_MARKED = re.compile("[0-9_.]")
_JUNK = re.compile(r"^\s*(?:[\[{<].*[\]}>]\s*|\|.*|.*\|\s*|\[\d+\].*|[-=*_#~\s]+|(?:[0-9a-f]{6,}\s*)+|[^;]*(?:;[^;\s]*){2,})$")
_PROSE = re.compile(r"\S+(?:\s+\S+){3,}[.!?…][\"'»”)\]]*\s*|.{8,}[。！？]\s*")
_CACHED_WORDS = 200_000
_LETTERS = 8  # a sentence has two words and so many letters, or four characters of a script without spaces


def label_language(label: str | None) -> str | None:
    """The language that a label names, or None."""
    if label is None:
        return None
    name = unicodedata.normalize("NFC", label).strip().casefold()
    return _BY_LABEL.get(name) or _BY_LABEL.get(re.split(r"[-_@. (]", name)[0])


def _repaired(m: re.Match) -> str:
    try:
        return b"".join(_CP1252.get(ch) or ch.encode("latin-1") for ch in m.group()).decode("utf-8")
    except (UnicodeDecodeError, UnicodeEncodeError):
        return m.group()


def clean(text: str) -> str:
    """Text with broken encodings and odd Unicode set right."""
    text = _BROKEN.sub(_repaired, text)
    text = unicodedata.normalize("NFKC", text)
    return re.sub("[­​-‏⁠﻿️]", "", text)


def parsed(text: str | None) -> list[tuple[str, list[str]]]:
    """The sentences of a text in order, each with its words; code, table rows, links and numbers left out."""
    if not text:
        return []
    lines = []
    for line in _BREAKS.split(clean(text)):
        bare = _LINK.sub(" ", line) if "www." in line or "://" in line else line
        if "\t" in bare.strip():  # a row of cells, unless cells hold whole sentences
            bare = " ".join(c.strip() for c in bare.split("\t") if _PROSE.fullmatch(c.strip()))
        if bare.strip() and not _JUNK.match(bare):
            lines.append(bare.strip())
        elif line.strip() and lines and lines[-1][-1:] not in ".!?…。！？":
            lines[-1] += "."
    out = []
    for part in _ENDS.split(" ".join(lines)):
        found = words(part) if part else []
        if len(found) > 1 and sum(map(len, found)) >= _LETTERS or any(len(w) > 3 and ord(w[0]) > 0x2E7F for w in found):
            out.append((part, found))
    return out


def sentences(text: str | None) -> list[str]:
    return [s for s, _ in parsed(text)]


def words(sentence: str) -> list[str]:
    """The words of a sentence without names and labels, in lower case; a sentence that is all quotation keeps its words."""
    if any(q in sentence for q in "\"«“„`「"):
        out = _plain_words(_QUOTED.sub(" ", sentence))
        if out:
            return out
    return _plain_words(sentence)


def _plain_words(bare: str) -> list[str]:
    out = []
    for run in _RUN.findall(bare):
        if run.islower() or run.isupper() or not _CAMEL.search(run):
            if not _MARKED.search(run):
                out += [w.lower() for w in run.split("-") if len(w) > 1 or w and ord(w) > 0x2E7F]
    return out


class Model:
    """Log-likelihoods of words under each language by character n-grams."""

    def __init__(self, langs: list[str], grams: dict[str, np.ndarray], unseen: dict[int, np.ndarray], order: int):
        self.langs, self.grams, self.unseen, self.order = langs, grams, unseen, order
        self.temper = (1.0, 0.0)
        self._cache: dict[str, np.ndarray] = {}

    @staticmethod
    def _grams(word: str, order: int) -> list[str]:
        w = f" {word} "
        scripts = ["あ" if 0x3040 <= ord(c) <= 0x30FF else "漢" if ord(c) > 0x2E7F else "я" for c in word if ord(c) >= 0x400]
        return [w[i:i + n] for n in range(1, order + 1) for i in range(len(w) - n + 1)] + scripts * 2

    @classmethod
    def train(cls, rows: list[tuple[str, str]], order: int = 4, smooth: float = 0.05) -> "Model":
        """From (language, clean sentence)."""
        return cls.of_words(Counter((lang, w) for lang, sentence in rows for w in words(clean(sentence))), order, smooth)

    @classmethod
    def of_words(cls, seen: dict[tuple[str, str], int], order: int = 4, smooth: float = 0.05) -> "Model":
        """From the counts of (language, word)."""
        langs = sorted({x for x, _ in seen})
        counts: dict[str, np.ndarray] = {}
        for (lang, w), n in seen.items():
            k = langs.index(lang)
            for g in cls._grams(w, order):
                if g not in counts:
                    counts[g] = np.zeros(len(langs))
                counts[g][k] += np.log2(1 + n)  # damped, so that common words don't make rare spellings unlikely
        kinds = {n: sum(len(g) == n for g in counts) for n in range(1, order + 1)}
        total = {n: np.sum([c for g, c in counts.items() if len(g) == n] or [np.zeros(len(langs))], axis=0) + smooth * max(1, kinds[n]) for n in kinds}
        grams = {g: np.log((c + smooth) / total[len(g)]) for g, c in counts.items()}
        return cls(langs, grams, {n: np.log(smooth / total[n]) for n in kinds}, order)

    def word(self, w: str) -> np.ndarray:
        found = self._cache.get(w)
        if found is None:
            found = np.zeros(len(self.langs))
            for g in self._grams(w, self.order):
                at = self.grams.get(g)
                found = found + (at if at is not None else self.unseen[len(g)])
            found = found / self.order  # the orders tell of the same letters
            if len(self._cache) >= _CACHED_WORDS:
                self._cache.clear()
            if len(w) <= 40:
                self._cache[w] = found
        return found

    def score(self, found: list[str]) -> np.ndarray:
        """The log-likelihoods of a sentence's words."""
        total = np.zeros(len(self.langs))
        for w in found:
            total += self.word(w)
        return total

    def sentence(self, s: str) -> np.ndarray:
        return self.score(words(s))

    def confidence(self, loglik: np.ndarray, n_words: int) -> np.ndarray:
        """How likely each language is, from the log-likelihoods of ``n_words`` words.

        N-grams overlap and words of one text depend on each other, so evidence is
        divided by a temperature that grows with the number of words.
        """
        scaled = loglik / (self.temper[0] * max(n_words, 1) ** self.temper[1])
        p = np.exp(scaled - scaled.max())
        return p / p.sum()

    def calibrate(self, rows: list[tuple[str, str]], folds: int = 4) -> None:
        """Fit the temperature to held-out sentences and their first words.

        Models of the other folds score the first 1, 2, 4, ... words of each sentence;
        base and exponent of the temperature are those of least log loss.
        """
        seen: list[tuple[int, np.ndarray, int]] = []
        for fold in range(folds):
            part = Model.train([r for i, r in enumerate(rows) if i % folds != fold], self.order)
            for i, (lang, s) in enumerate(rows):
                found = words(clean(s)) if i % folds == fold and lang in part.langs else []
                n = 1
                while found:
                    seen.append((min(n, len(found)), part.score(found[:n]), part.langs.index(lang)))
                    if n >= len(found):
                        break
                    n *= 2
        if not seen:
            return
        n = np.array([x[0] for x in seen], dtype=float)
        width = max(len(x[1]) for x in seen)
        tilt = np.array([np.pad(x[1] - x[1][x[2]], (0, width - len(x[1])), constant_values=-np.inf) for x in seen])  # against the right language
        best = np.inf
        for base in np.geomspace(0.5, 8.0, 17):
            for power in np.linspace(0.0, 1.0, 11):
                loss = float(np.logaddexp.reduce(tilt / (base * n ** power)[:, None], axis=1).mean())
                if loss < best:
                    best, self.temper = loss, (float(base), float(power))


def mixture(loglik: np.ndarray, penalty: float = 8.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(proportions of languages, posteriors of sentences) of one document.

    EM over the proportions, then languages are dropped, the least needed first,
    as long as that costs less than ``penalty`` of log-likelihood.
    """
    def em(live: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        part = loglik[:, live]
        top = part.max(axis=1, keepdims=True)
        like = np.exp(part - top)
        pi = np.full(len(live), 1 / len(live))
        for _ in range(rounds):
            joint = like * pi
            post = joint / joint.sum(axis=1, keepdims=True)
            new = post.mean(axis=0)
            if np.abs(new - pi).max() < 1e-6:
                pi = new
                break
            pi = new
        joint = like * np.maximum(pi, 1e-300)
        return float((np.log(joint.sum(axis=1)) + top[:, 0]).sum()), pi, joint / joint.sum(axis=1, keepdims=True)

    live = sorted(set(loglik.argmax(axis=1).tolist()))
    best = em(live)
    while len(live) > 1:
        without = [(em([k for k in live if k != x]), x) for x in live]
        least, x = max(without, key=lambda w: w[0][0])
        if best[0] - least[0] >= penalty:
            break
        live, best = [k for k in live if k != x], least
    pi, post = np.zeros(loglik.shape[1]), np.zeros(loglik.shape)
    pi[live], post[:, live] = best[1], best[2]
    return pi, post


def stretches(model: Model, text: str | None, penalty: float = 8.0) -> list[tuple[str, float, int]]:
    """(language, confidence, sentences) of each stretch of a text, in order.

    The confidence is the tempered probability of the language on all words of the
    stretch, see ``Model.confidence``.
    """
    found = parsed(text)
    if not found:
        return []
    loglik = np.array([model.score(w) for _, w in found])
    first = loglik.argmax(axis=1)
    if (first == first[0]).all():  # one language leads throughout: nothing to weigh up
        of = first
    else:
        pi, post = mixture(loglik, penalty)
        of = np.full(len(found), int(pi.argmax())) if int((pi > 0).sum()) == 1 else post.argmax(axis=1)
    out: list[tuple[str, float, int]] = []
    ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
    begin = 0
    for end in ends:
        k = int(of[begin])
        sure = model.confidence(loglik[begin:end].sum(axis=0), sum(len(w) for _, w in found[begin:end]))
        out.append((model.langs[k], float(sure[k]), end - begin))
        begin = end
    return out


def fit(df: DataFrame, samples: DataFrame, id_col: str, text: str, label: str, fit_documents: int = 4_000, fit_sentences: int = 60, margin: float = 5.0) -> Model:
    """The model of the samples, fitted to the corpus on a bounded set of labelled documents.

    At most ``fit_documents`` documents whose label names a language, chosen by the
    hash of their id, give at most ``fit_sentences`` sentences each; those that the
    samples' model puts in the labelled language by ``margin`` add their words. The
    bounds hold at any size of the corpus and for the fitting only.
    """
    seed = [(r[0], r[1]) for r in samples.collect() if r[0] is not None and r[1]]
    seen = Counter((lang, w) for lang, sentence in seed for w in words(clean(sentence)))
    if not seen or fit_documents <= 0:
        return Model.of_words(seen)
    first = Model.of_words(seen)
    first.calibrate(seed)
    named = df.where(F.lower(F.trim(F.col(label))).isin([n for n, code in _BY_LABEL.items() if code in first.langs]))
    chosen = named.select(F.col(id_col).alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(fit_documents)
    picked = df.join(F.broadcast(chosen), df[id_col] == F.col("__id"), "left_semi").select(F.col(text).alias("text"), F.col(label).alias("label"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for t, label in zip(b.iloc[:, 0], b.iloc[:, 1]):
                lang = label_language(label)
                for _, found_words in parsed(t)[:fit_sentences]:
                    v = first.score(found_words)
                    k = int(v.argmax())
                    if first.langs[k] == lang and v[k] - np.delete(v, k).max(initial=-np.inf) > margin:
                        found.update((lang, w) for w in found_words)
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["lang", "word", "n"])

    for r in spread(picked).mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        seen[r.lang, r.word] += r.n
    fitted = Model.of_words(seen)
    fitted.temper = first.temper
    return fitted


def identify(df: DataFrame, samples: DataFrame, id_col: str, text: str, label: str, penalty: float = 8.0, fit_documents: int = 4_000) -> DataFrame:
    """id, seg_no, lang, confidence, n_sentences, is_case of every stretch of every document.

    ``samples``: (lang, sample_text), a small fixed table. ``is_case``: the label is
    missing or names no language of the samples, names another than the text's, or
    the text has several stretches. Null, empty and blank texts, and texts of
    numbers, symbols or code only, give no rows. Other columns are ignored.
    """
    model = fit(df, samples, id_col, text, label, fit_documents)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, label in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2]):
                found = stretches(model, text, penalty)
                case = len({x[0] for x in found}) > 1 or bool(found) and label_language(label) != found[0][0]
                out += [(i, n, lang, conf, count, case) for n, (lang, conf, count) in enumerate(found)]
            yield pd.DataFrame(out, columns=["id", "seg_no", "lang", "confidence", "n_sentences", "is_case"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"), F.col(label).alias("label"))
    return spread(picked).mapInPandas(run, "id long, seg_no long, lang string, confidence double, n_sentences int, is_case boolean").withColumnRenamed("id", id_col)
