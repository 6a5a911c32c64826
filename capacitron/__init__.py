"""capacitron — storage-sizing analytics expressed as Spark DataFrame / SQL plans.

Layout
------
sources/    readers: driver test tables, result-folder trees, CSV sheets, registers
functions/  column-expression builders (NULL/NaN/ANSI guards, scalar parsers, statistics)
operators/  DataFrame operators: warehouse joins, benefits, series features, PV, ML, ...
plans/      the query catalogue (one DataFrame builder + one DuckDB oracle per operator id)
streaming/  Structured Streaming jobs (incremental feature store, submission scoring)
"""

__version__ = "0.1.0"
