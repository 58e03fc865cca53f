"""All queries of the library with their equivalent SQL."""

from . import corpus_queries, file_queries, more_queries, speech_queries, table_queries, text_queries, whole_queries  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "j11_vocabulary"
