"""Set filters over bounded id universes, evaluated with Spark DataFrames."""
