"""Column functions, each with the DuckDB SQL of the same result where tests need one."""
