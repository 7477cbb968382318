import pytest

from colmatch.functions import names as N
from colmatch.functions.types import AlgorithmError, Config, InvalidConfig, check_work


@pytest.mark.parametrize("f,a,b,want", [
    (N.levenshtein_similarity, "kitten", "sitting", 4 / 7), (N.levenshtein_similarity, "", "", 1.0), (N.damerau_similarity, "CA", "ABC", 1 / 3),
    (N.hamming_similarity, "café", "cafe", 0.75), (N.hamming_similarity, "ab", "abc", 2 / 3), (N.levenshtein_similarity, "東京", "東海", 0.5),
    (N.jaro, "MARTHA", "MARHTA", 17 / 18), (N.jaro_winkler, "MARTHA", "MARHTA", 0.9611111111111111), (N.trigram_similarity, "aaaa", "aaa", 2 / 3),
    (N.tokens_similarity, "ApproxDate", "date_created_approximation", 0.8), (N.flooding_word_similarity, "Dept", "Department", 0.16),
    (N.flooding_word_similarity, "date", "Birthdate", 16 / 81), (N.prefix_suffix, "ColumnType", "Column", 2 / 3)])
def test_measures(f, a, b, want):
    assert f(a, b) == pytest.approx(want, abs=1e-12)


def test_tokens():
    assert N.tokens("XMLHTTPRequest42_id_ID") == ("xmlhttp", "request", "42", "id")


def test_names():
    assert N.name_score("customer_id", "CustomerID") == 1.0
    assert N.tokenize_name("qty_item") == {"quantity", "product"}
    assert N.abbreviation_score("wspd", "wind_spd") > 0.5 and N.abbreviation_score("xyz", "abc") == 0.0
    assert N.normalize_name("ΑΣ-1") == "ασ1"


def test_limits_and_config():
    check_work("x", 5, 5)
    check_work("x", 5, None)
    with pytest.raises(AlgorithmError, match="6 exceeds the limit of 5"):
        check_work("x", 6, 5)
    with pytest.raises(InvalidConfig):
        Config(min_score=1.5)
