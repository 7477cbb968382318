"""Byte-level BPE over the whole corpus with Spark's higher-order functions.

Bytes are handled as strings of characters U+0000 to U+00FF (one per byte). The
rank map is one row of a scalar subquery: an array of small maps, found by CRC32 of the
piece. A word is folded by merging the neighbours of lowest rank, one merge per step, while
the ranks of the pairs are carried along so that a step looks up two pairs only.

The most frequent words of the corpus are folded once and become a second such row
of at most ``dictionary_words`` entries, a fixed bound, found by the hash of the word
as it stands in the text. Tasks are sent both rows as they would be sent literals, but
entries of a literal stand in the text of every plan, which the driver keeps of each
query. Every other word is turned into bytes and folded where it
stands, so no word is treated otherwise than another and no text leaves its row: the
only shuffle is the count of words.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colmatch.plans.shared import materialize, spread

# The split pattern of the vocabulary, with white space as Unicode has it.
_W, _L, _N = r"\p{IsWhite_Space}", r"\p{L}", r"\p{N}"
SPLIT = rf" ?{_L}++|'(?:[stmd]|re|ve|ll)| ?{_N}++| ?[^{_W}{_L}{_N}]++|{_W}+(?![^{_W}])|{_W}+"
_NONE = 2_147_483_647
_RANK_BUCKETS = 16_384
_RANKS, _KNOWN = "__ranks", "__known"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the rank file is; a parameter everywhere else."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[str, int]:
    """Piece (a character per byte) to rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, f) if a}


def _row(spark: SparkSession, maps: list[dict], kind: str) -> DataFrame:
    """The maps as one array, in one row of the shared folder."""
    text = spark.createDataFrame([(json.dumps(maps),)], "maps string")
    return materialize(text.select(F.from_json("maps", f"array<map<string,{kind}>>").alias("maps")), "maps")


def rank_row(spark: SparkSession, path: str) -> DataFrame:
    """One row: the ranks of the vocabulary; that of piece k is in the map at crc32(k) mod the number of maps."""
    out: list[dict] = [{} for _ in range(_RANK_BUCKETS)]
    for k, v in load_ranks(path).items():
        out[zlib.crc32(k.encode()) % _RANK_BUCKETS][k] = v
    return _row(spark, out, "int")


def _find(maps: Column, buckets: int, key: Column) -> Column:
    return F.try_element_at(F.get(maps, (F.crc32(F.encode(key, "UTF-8")) % buckets).cast("int")), key)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def byte_string(text: Column) -> Column:
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def split_words(text: Column) -> Column:
    """The pieces of a text that are encoded one by one; none for null and empty text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0))


def _fold(word: Column, rank) -> Column:
    """The ids of a word of two bytes or more. ``rank(piece)``: its rank, or null."""
    pair = lambda a, b: F.coalesce(rank(F.concat(a, b)), F.lit(_NONE))

    none = F.array().cast("array<int>")

    def merge(state: Column, at: Column) -> Column:
        p, r = state["p"], state["r"]

        def joined(m: Column) -> Column:
            left = F.when(at > 1, F.array(pair(F.get(p, at - 2), m))).otherwise(none)
            right = F.when(at < F.size(r), F.array(pair(m, F.get(p, at + 1)))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), at - 1), F.array(m), F.slice(p, at + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r))).alias("r"))

        return _let(F.concat(F.get(p, at - 1), F.get(p, at)), joined)

    def step(state: Column, _: Column) -> Column:
        mended = lambda least: F.when(least < _NONE, _let(F.array_position(state["r"], least).cast("int"), lambda at: merge(state, at))).otherwise(state)
        return _let(F.array_min(state["r"]), mended)

    def run(chars: Column) -> Column:
        start = F.struct(chars.alias("p"), F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: pair(F.get(chars, i - 1), F.get(chars, i))).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.size(chars) - 1), start, step, lambda s: F.transform(s["p"], rank))

    return _let(F.split(word, ""), run)


def _ids_of(words: Column, ranks: Column, known: Column | None = None, buckets: int = 0) -> Column:
    """array<array<int>>: the ids of each word. ``known``: ids by word, in ``buckets`` maps by hash."""
    def with_ranks(ranks: Column) -> Column:
        rank = lambda piece: _find(ranks, _RANK_BUCKETS, piece)
        one = lambda b: _let(rank(b), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(_fold(b, rank)))
        folded = lambda w: _let(byte_string(w), one)
        if known is None:
            return F.transform(words, folded)
        there = lambda maps: F.transform(words, lambda w: F.coalesce(F.try_element_at(F.get(maps, F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")), w), folded(w)))
        return _let(known, there)

    return _let(ranks, with_ranks)


def frequent_words(df: DataFrame, text: str, ranks: DataFrame, dictionary_words: int) -> tuple[DataFrame | None, int]:
    """(one row of maps from word to ids of the most frequent words, number of maps); at most ``dictionary_words`` words."""
    counted = (df.select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .orderBy(F.desc("n"), "word").limit(dictionary_words))
    buckets = max(64, dictionary_words // 2)
    coded = counted.select("word").repartition(df.sparkSession.sparkContext.defaultParallelism).withColumn(_RANKS, ranks.scalar()).select(
        "word", F.get(_ids_of(F.array("word"), F.col(_RANKS)), F.lit(0)).alias("ids"), F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int").alias("at"))
    maps: list[dict] = [{} for _ in range(buckets)]
    for r in coded.collect():
        maps[r["at"]][r["word"]] = list(r["ids"])
    return (_row(df.sparkSession, maps, "array<int>") if any(maps) else None), buckets


def encode(df: DataFrame, text: str, path: str | None = None, ids: str = "ids", dictionary_words: int = 32_768) -> DataFrame:
    """``df`` with the token ids of ``text``, array<int>, without special tokens.

    Null and empty texts have the empty list. Strings that look like special tokens
    are ordinary text. A column named ``ids`` is replaced; others stay. Whole texts
    are encoded, however long.
    """
    df = spread(df)
    ranks = rank_row(df.sparkSession, path or vocabulary_path())
    known, buckets = frequent_words(df, text, ranks, dictionary_words) if dictionary_words else (None, 0)
    held = {_RANKS: ranks.scalar()} | ({} if known is None else {_KNOWN: known.scalar()})  # a subquery may not stand in a higher-order function itself; the optimizer puts it there
    coded = _ids_of(split_words(F.col(text)), F.col(_RANKS), None if known is None else F.col(_KNOWN), buckets)
    return df.withColumns(held).withColumn(ids, F.flatten(coded)).drop(*held)


def decode(df: DataFrame, ids: str, path: str | None = None, text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids``: the pieces' bytes put together. The empty list gives ''; null gives null."""
    ranks = load_ranks(path or vocabulary_path())
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    literal = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return df.withColumn(text, F.decode(F.encode(_let(literal, lambda p: F.array_join(F.transform(F.col(ids), lambda i: F.get(p, i)), "")), "ISO-8859-1"), "UTF-8"))
