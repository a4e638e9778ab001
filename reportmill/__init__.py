"""reportmill: report analytics expressed as PySpark DataFrame operators."""
