"""Importing this package fills the registry."""

from . import clicks, files, pairs, profile_fields, profiles, records, remarks, sales, streams  # noqa: F401
from .registry import REPORTS  # noqa: F401
