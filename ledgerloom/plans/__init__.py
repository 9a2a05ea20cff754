"""Domain views over the given tables, registered queries and their oracle SQL."""
