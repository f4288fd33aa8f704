"""Lithic: retrieval and risk analytics expressed as Spark DataFrame plans."""
