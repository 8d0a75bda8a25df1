"""Evidence analytics on Spark: sources, operators, plans and functions as DataFrame and SQL expressions."""
