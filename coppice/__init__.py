"""Coppice: structural-code analytics and corpus operators as Spark DataFrame jobs."""
