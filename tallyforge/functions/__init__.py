"""Column functions: native expressions and Arrow UDFs."""
