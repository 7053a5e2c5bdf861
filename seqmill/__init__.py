"""seqmill: a PySpark-native engine for mining gene-marker sequences.

Subpackages: ``functions`` (column expressions), ``sources`` (readers and
writers), ``operators`` (DataFrame -> DataFrame), ``plans`` (whole pipelines
and the query catalogue), ``streaming`` (incremental ingest).
"""

__version__ = "0.1.0"
