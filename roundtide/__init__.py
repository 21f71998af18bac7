"""Ticket-timeline analytics as Spark DataFrame, SQL and streaming jobs."""
