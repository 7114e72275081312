"""Table operators.  Each function takes and returns ``DataFrame``."""
