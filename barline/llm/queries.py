"""The registered queries of this subpackage. Importing the operators fills the registry."""

from barline.llm import (  # noqa: F401
    conversations,
    decontamination,
    embedding_forest,
    exact_dedup,
    language,
    language_model,
    lexical_search,
    mixing,
    ngram_join,
    page_text,
    quality,
    secrets,
    web_archive,
)
from barline.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
