"""Column expressions and the functions behind Arrow UDFs."""
