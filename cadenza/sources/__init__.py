"""Readers, views of the driver's tables, generators and writers."""
