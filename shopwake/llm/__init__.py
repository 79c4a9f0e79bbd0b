"""Operators of a training-data pipeline; nothing else in the library needs them.

Importing this package fills the registry of its queries.
"""

from . import corpus, manifests, pages, passages, phrases, scores  # noqa: F401
from .queries import QUERIES, SQL  # noqa: F401
