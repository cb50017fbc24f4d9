"""Sources: SQL, JDBC, schema discovery and incremental reads."""
