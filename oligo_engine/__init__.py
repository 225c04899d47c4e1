"""Spark jobs for designing and screening short interfering RNA duplexes."""
