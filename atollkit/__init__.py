"""Systematic conservation planning data work as Spark DataFrame jobs."""
