"""quayline - shipping-priority analytics on Spark.

``Tables`` opens a data set, ``operators`` holds the building blocks (each one takes and
returns DataFrames), ``plans`` the ready-made reports and ``streaming`` the live versions.
"""

from quayline.sources.tables import Tables

__all__ = ["Tables"]
