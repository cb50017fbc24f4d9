"""Writers: tables, JDBC, log lines and messages."""
