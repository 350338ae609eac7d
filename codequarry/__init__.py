"""codequarry: repository analytics as PySpark DataFrame operators."""
