"""Column expressions.  Each function takes and returns ``Column``."""
