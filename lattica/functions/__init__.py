"""Column expressions: predicates, aggregates, text functions and patterns."""
