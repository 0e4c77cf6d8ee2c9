"""pairsmith: Spark-native curation and entity linking for sentence-pair datasets.

Operators take and return DataFrames (``pairsmith.operators``), column
functions live in ``pairsmith.functions``, readers/writers in
``pairsmith.sources``, incremental writers in ``pairsmith.streaming`` and the
query registry bound to the driver's tables in ``pairsmith.plans``.
"""

__version__ = "0.1.0"
