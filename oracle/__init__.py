"""DuckDB SQL with the same results as the registered queries."""
