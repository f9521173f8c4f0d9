"""pressline: article-corpus analytics expressed as Spark DataFrame / SQL jobs.

Sub-packages
------------
functions  Column -> Column helpers (text markup, labels, HTML extraction); no UDFs.
sources    readers and writers (article tables, landed listings, corpora, run records).
operators  relational building blocks (sampling, profiling, metrics, packing, vocabularies).
plans      whole jobs composed from the above (training sets, dashboards, classifiers),
           plus the query catalog used by ``__spark_entry__``.
streaming  the incremental ingest as a Structured Streaming query.
"""

__all__ = ["session"]
