"""Column builders: output columns, rules and templates."""
