"""String functions: all built from Spark's own, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def repo_of(node_id: Column) -> Column:
    """The part of an id before the first colon."""
    return F.substring_index(node_id, ":", 1)


def normalised(x: Column) -> Column:
    """Lower case, without anything but letters, digits and underscores."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9_]", "")


def plural_stem(x: Column) -> Column:
    """Fold English plurals of names: -ies to -y, -sses -xes -ches -shes lose es, -s goes."""
    return (
        F.when(x.endswith("ies") & (F.length(x) > 4), F.concat(x.substr(F.lit(1), F.length(x) - 3), F.lit("y")))
        .when(x.rlike("(ss|x|ch|sh)es$"), x.substr(F.lit(1), F.length(x) - 2))
        .when(x.endswith("s") & ~x.endswith("ss") & (F.length(x) > 3), x.substr(F.lit(1), F.length(x) - 1))
        .otherwise(x)
    )


def split_words(x: Column) -> Column:
    """The words of a name in camel, snake or path case, in lower case."""
    return F.transform(F.regexp_extract_all(x, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0)), F.lower)


def search_words(x: Column) -> Column:
    """The searchable words of a text: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9_]+)"), F.lit(1))


def keyword_words(x: Column, least: int = 2) -> Column:
    """Distinct words of letters and digits of at least so many characters."""
    return F.array_distinct(
        F.filter(F.regexp_extract_all(F.lower(x), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: F.length(w) >= least)
    )


def base_id(x: Column) -> Column:
    """An id without the parameter list."""
    return F.regexp_replace(x, r"\(.*$", "")


def slug(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), F.lit("-"))


def first_sentence(x: Column, most: int = 200) -> Column:
    """The text up to its first sentence end, cut at a word with an ellipsis."""
    one = F.trim(F.regexp_extract(F.regexp_replace(x, r"\s+", " "), r"^(.*?[.!?])(?:\s|$)|^(.*)$", 0))
    cut = F.regexp_replace(one.substr(F.lit(1), F.lit(most - 1)), r"\s+\S*$", "")
    return F.when(F.length(one) <= most, one).otherwise(F.concat(cut, F.lit("…")))


#: Folders of tests; ends of folder names; names of test files.
_TEST_FOLDER = r"(?i:(^|/)(tests?|__tests__|specs?|e2e|testing)/)"
_TESTS_FOLDER = r"(^|/)([^/]*[._a-z-])?Tests?/"
_TEST_FILE = r"(^|/)(test_[^/]*\.py|[^/]*_test\.py|conftest\.py|[^/]*\.(test|spec)\.[cm]?[jt]sx?|[^/]*Tests?\.cs)$"


def test_path(x: Column) -> Column:
    """Is this the path of a test file?"""
    at = F.replace(x, F.lit("\\"), F.lit("/"))
    return at.rlike(_TEST_FOLDER) | at.rlike(_TESTS_FOLDER) | at.rlike(_TEST_FILE)


def route_segments(url: Column) -> Column:
    """Path segments of an address, without scheme, host, query and fragment."""
    path = F.regexp_replace(F.split(url, "[?#]")[0], "^[a-z]+://[^/]+", "")
    return F.filter(F.split(path, "/"), lambda x: x != "")
