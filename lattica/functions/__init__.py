"""Column functions: text rules, predicates and vector arithmetic."""
