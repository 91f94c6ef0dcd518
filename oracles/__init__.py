"""Independent DuckDB SQL for every SQL-checkable query (see oracle_sql())."""
