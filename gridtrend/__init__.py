"""gridtrend: repeated field surveys along climate grids, as Spark jobs."""
