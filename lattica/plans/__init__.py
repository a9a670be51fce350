"""Plans: the registered queries and the end-to-end flows."""
