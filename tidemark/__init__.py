"""Code-health analytics on Spark: sources, operators, scoring, comparison, policy and streams."""
