"""ledgerflow: the data side of a tax-return practice as PySpark jobs.

Every job takes DataFrames (plus an explicit ``as_of`` clock where time
matters) and returns a DataFrame, so the same code runs on a laptop sample
and on a cluster.  Sub-packages:

- ``sources``   declared schemas, parquet / binary-file / JDBC readers, sinks
- ``functions`` reusable Column expressions (PG-compatible NULL rules, time)
- ``operators`` filters, joins, aggregates, paging, change application,
                data quality, entitlements
- ``plans``     the named queries over the stand-in views and their SQL oracles
- ``streaming`` windowed request-rate monitors and the live activity union
"""

__version__ = "0.1.0"
