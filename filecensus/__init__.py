"""File-inventory and risk analytics on Spark.

An inventory of files is a DataFrame, a scan is a snapshot of it, and the reports
machines send are a stream.  Every operator takes DataFrames and returns DataFrames.
"""

from filecensus.operators.rules import Rules
from filecensus.session import get_session, work_dir

__all__ = ["Rules", "get_session", "work_dir"]
