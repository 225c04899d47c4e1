"""The registered queries: inputs derived from the driver tables, Spark queries and
their SQL counterparts."""


def load():
    """Import all query modules and return (queries, sql) by name."""
    from oligo_engine.catalog import data_queries, registry, scan_queries, screen_queries, sequence_queries  # noqa: F401

    return registry.QUERIES, registry.SQL
