"""daftar: legal-knowledge analytics as PySpark DataFrame operators."""
