"""patchloom: a Spark-native engine for analysing corpora of unified diffs.

Diffs are rows; sections (one per file in a diff), chunks and indexes are
tables derived from them with built-in Spark SQL expressions.
"""

from patchloom.options import LoadOptions

__all__ = ["LoadOptions"]
__version__ = "0.1.0"
