"""bitwave: compressed-audio bitstreams and corpus tables as Spark DataFrames."""
