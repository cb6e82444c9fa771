"""The query algebra, the query catalogue and its SQL twins."""
