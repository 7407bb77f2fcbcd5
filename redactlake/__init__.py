"""A privacy-audit and text-preparation engine on Spark DataFrames."""
