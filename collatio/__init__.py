"""Quotation-accuracy analytics expressed as PySpark DataFrame plans."""
