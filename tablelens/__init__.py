"""tablelens: a PySpark-native engine for open-table-format metadata.

Core subpackages

* ``model`` / ``codec`` -- strict, round-trip-safe documents (driver side)
* ``functions``  -- partition transforms and sort orders as Catalyst columns
* ``operators``  -- distributed operators over metadata tables
* ``sources``    -- bulk text source, sink and a Python data source
* ``streaming``  -- Structured Streaming forms of incremental operators
* ``plans``      -- registered queries and their SQL counterparts
"""

__version__ = "0.1.0"
