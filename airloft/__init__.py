"""Environmental-sensing analytics as PySpark DataFrame operators."""
