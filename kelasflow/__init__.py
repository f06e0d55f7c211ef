"""kelasflow: learning-records analytics as set-wise Spark jobs.

Every operator takes a :class:`~kelasflow.sources.catalog.Tables` bundle of
DataFrames (the learning schema) and returns a lazy DataFrame; nothing is
collected inside an operator.
"""

from kelasflow.session import build_session, ensure_checkpoint_dir
from kelasflow.sources.catalog import Tables

__all__ = ["build_session", "ensure_checkpoint_dir", "Tables"]
