"""Code and text analytics on Spark: extraction, scoring, rule matching, resolution, graphs, coverage and corpus preparation."""
