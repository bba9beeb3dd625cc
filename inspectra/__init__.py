"""inspectra — inspection-risk analytics expressed as Spark DataFrame plans.

Stages (each a function DataFrame -> DataFrame, lazily planned by Catalyst):

* ``sources``   — typed readers for landing data and the stand-in adapters
* ``operators`` — panel build, cleaning, summaries, statistics, features,
                  evaluation, serving tables and MLlib modelling
* ``functions`` — column expressions shared by the operators (no Python UDFs)
* ``plans``     — the named query catalogue and its SQL twins
* ``streaming`` — incremental enrichment load on Structured Streaming
"""

__version__ = "0.1.0"
