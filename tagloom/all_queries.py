"""All registered queries outside the corpus subpackage."""

from tagloom import queries_functions, queries_reports, queries_reviews, queries_scoring, queries_streaming, queries_tables  # noqa: F401
from tagloom.registry import ORACLES, QUERIES  # noqa: F401
