"""Imports every module that registers queries."""

from checks import collections, dataset, embedded, files, retrieval, stores, text, whole  # noqa: F401
from checks.registry import ORACLES, QUERIES  # noqa: F401
