"""noteloom: clinical-text analytics as PySpark DataFrame operators."""
