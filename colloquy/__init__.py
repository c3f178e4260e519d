"""colloquy: conversation analytics on Spark.

Every operator is a function from DataFrames to a DataFrame built from
``pyspark.sql.functions`` expressions, joins, aggregations and windows, so
Catalyst plans it and whole-stage codegen runs it. Sub-packages:

- ``sources``   bundle reader and gates, table loading, fixture bindings
- ``functions`` Column-level helpers (parsing, labelling, matching)
- ``operators`` enrichment, analytics, graph, retrieval, ordering, sinks
- ``plans``     composite jobs (ingestion, dashboard, detail, registry)
- ``streaming`` incremental bundle ingestion with Structured Streaming
"""

__version__ = "0.1.0"
