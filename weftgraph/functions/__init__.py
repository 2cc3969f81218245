"""Scalar functions of the engine as column expressions."""

from weftgraph.functions.text import (  # noqa: F401
    base_id,
    first_sentence,
    keyword_words,
    normalised,
    plural_stem,
    repo_of,
    route_segments,
    search_words,
    slug,
    split_words,
    test_path,
)
