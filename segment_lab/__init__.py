"""segment_lab: Spark-native analytics for ordered collections cut into segments.

Every public operator takes DataFrames (plus column names / parameters) and
returns a DataFrame; the row-level work is expressed with the DataFrame API so
Catalyst can push filters, prune columns and pick join strategies.
"""

__version__ = "0.1.0"
