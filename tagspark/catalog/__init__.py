"""The operators as queries on the given tables, each with its SQL."""
