"""copyledger: content catalog and deduplication as Spark DataFrame jobs.

Entry points: ``copyledger.registry.REGISTRY`` (one query per operator),
``copyledger.plans`` (catalog build, incremental scan, dedup plan, store,
report) and ``copyledger.streaming.ingest`` (streaming catalog ingest).
"""

__version__ = "0.1.0"
