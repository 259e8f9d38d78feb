"""Records as JSON and addresses in text; files and streams come from Spark's own readers."""
