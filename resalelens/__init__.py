"""resalelens: home-resale transaction analytics on Spark DataFrames.

Every operator takes a DataFrame and returns a DataFrame; nothing inside the
library collects rows to the driver unless its docstring says so (facet
helpers that feed a UI).

Layout
------
sources/    readers and writers (JSON envelopes, month-partitioned sources,
            history union, record sink, month generators, projection spec)
functions/  column-expression helpers (text rewriting, binning, geodesy)
operators/  DataFrame -> DataFrame operators (clean, search, trends, box
            statistics, published analyses, geo, facets)
plans/      the stand-in view over the test tables and the query catalogue
streaming/  incremental month ingest with Structured Streaming
"""

from resalelens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
