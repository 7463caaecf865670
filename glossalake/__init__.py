"""Spark-first analytics engine for multilingual documents, glossaries and logs."""
