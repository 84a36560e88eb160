"""The registered queries: adapters over the given tables, Spark queries, and their SQL oracles."""
