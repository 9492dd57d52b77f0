"""Input views on the driver tables and the query catalogue."""
