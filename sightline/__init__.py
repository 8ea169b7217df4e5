"""Analytics over vehicle sightings, as composable Spark DataFrames."""
