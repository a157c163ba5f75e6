"""dossiergrid: a PySpark-native analytics engine for career documents.

Every operator takes and returns DataFrames. Relational and scalar work is
expressed with Catalyst functions; Python runs only where line-by-line parsing
cannot be expressed otherwise, always in Arrow batches.
"""

__version__ = "0.1.0"
