"""Automated analytics for Spark tables and streams."""

from tallylens.plans.analyze import Analysis, analyze, document, run
from tallylens.plans.ingest import Ingested, describe_and_clean, ingest
from tallylens.session import build_session
from tallylens.sources.files import exact_sample, read_table, write_table

__all__ = [
    "Analysis", "Ingested", "analyze", "build_session", "describe_and_clean", "document", "exact_sample", "ingest",
    "read_table", "run", "write_table",
]
