"""Scalar functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colmatch.functions.names import SYNONYMS

# English stop words.
STOP_WORDS = (
    "a about above after again against ain all am an and any are aren aren't as at be because been before being below between both but by can couldn couldn't "
    "d did didn didn't do does doesn doesn't doing don don't down during each few for from further had hadn hadn't has hasn hasn't have haven haven't having he "
    "he'd he'll her here hers herself he's him himself his how i i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself i've just ll m ma me mightn "
    "mightn't more most mustn mustn't my myself needn needn't no nor not now o of off on once only or other our ours ourselves out over own re s same shan shan't "
    "she she'd she'll she's should shouldn shouldn't should've so some such t than that that'll the their theirs them themselves then there these they they'd "
    "they'll they're they've this those through to too under until up ve very was wasn wasn't we we'd we'll we're were weren weren't we've what when where which "
    "while who whom why will with won won't wouldn wouldn't y you you'd you'll your you're yours yourself yourselves you've"
).split()


def normalized_name(name: Column) -> Column:
    """Letters and digits in lower case; ASCII and other simple scripts as in ``names.normalize_name``."""
    return F.lower(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]", ""))


def name_words(name: Column) -> Column:
    """The distinct words of a name, synonyms replaced."""
    words = F.filter(F.split(F.lower(name), r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    table = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)))


def name_tokens(name: Column) -> Column:
    """Camel, Pascal, acronym and digit parts in lower case, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|\p{Nd}+"), F.lit(0)), F.lower))


def document_tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers without stop words, repeats kept."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~F.array_contains(stop, w))


def suggestion_type_score(a: Column, b: Column) -> Column:
    numeric = ["integer", "float", "decimal"]
    return (F.when((a == "unknown") | (b == "unknown"), 0.5).when(a == b, 1.0)
             .when(a.isin(numeric) & b.isin(numeric), 0.75)
             .when(a.isin("date", "timestamp") & b.isin("date", "timestamp"), 0.65).otherwise(0.0))


def type_similarity(a: Column, b: Column) -> Column:
    """By family: the same 1, integer with float .5, text with date .3, else 0."""
    family = lambda t: (F.when(t == "integer", "int").when(t.isin("float", "decimal"), "float").when(t.isin("date", "timestamp"), "date").otherwise(t))
    x, y = family(a), family(b)
    return (F.when(x == y, 1.0).when(x.isin("int", "float") & y.isin("int", "float"), 0.5)
             .when(x.isin("text", "date") & y.isin("text", "date"), 0.3).otherwise(0.0))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    shorter = F.least(F.char_length(a), F.char_length(b))
    equal = F.size(F.filter(F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))), lambda i: (i <= shorter) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))))
    return F.when(longest == 0, 1.0).otherwise(equal / longest)


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice over the multisets of lower-case trigrams; shorter strings are one gram."""
    def grams(x: Column) -> Column:
        low = F.lower(x)
        n = F.char_length(low)
        return F.when(n < 3, F.array(low)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))

    count = lambda xs, g: F.size(F.filter(xs, lambda y: y == g))
    dice = let(grams(a), lambda p: let(grams(b), lambda q: 2 * F.aggregate(
        F.array_intersect(p, q), F.lit(0), lambda acc, g: acc + F.least(count(p, g), count(q, g))) / (F.size(p) + F.size(q))))
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(dice)


def tversky(shared_a: Column, n_a: Column, shared_b: Column, n_b: Column, alpha: float, beta: float) -> Column:
    """The better direction of matched / (matched + alpha own unmatched + beta other's unmatched)."""
    own, other = n_a - shared_a, n_b - shared_b
    one = F.try_divide(shared_a.cast("double"), shared_a + alpha * own + beta * other)
    two = F.try_divide(shared_b.cast("double"), shared_b + alpha * other + beta * own)
    return F.coalesce(F.greatest(one, two), F.lit(0.0))


def float_cutoff(threshold: float) -> float:
    """The threshold as a 32-bit float, at which similarities of texts are cut."""
    import numpy as np

    return float(np.float32(threshold))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_vector(v: Column) -> Column:
    """Scaled by the largest magnitude, then to length 1; null for zero and non-finite vectors."""
    top = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))

    def shortened(t: Column) -> Column:
        return let(F.transform(v, lambda x: x.cast("double") / t), lambda scaled: let(
            F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.transform(scaled, lambda x: x / norm)))

    return let(top, lambda t: F.when((t > 0) & (t < float("inf")) & ~F.isnan(t), shortened(t)))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, within -1 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))
