"""Lorebase: a document knowledge base with crawling, extraction and exact vector search on Spark."""

from pyspark import cloudpickle as _cloudpickle

# Functions used inside tasks travel with the job, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(__import__(__name__))

from lorebase.schema import KB_SCHEMA  # noqa: E402
from lorebase.session import build_session, materialize, work_dir  # noqa: E402

__all__ = ["KB_SCHEMA", "build_session", "materialize", "work_dir"]
