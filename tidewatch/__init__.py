"""tidewatch: as-of panels, walk-forward models and corpus jobs on Spark DataFrames."""
