"""Search, collection, join, facet and text operators over DataFrames."""
