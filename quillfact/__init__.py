"""Fact analytics and corpus operators expressed as Spark DataFrame jobs."""
