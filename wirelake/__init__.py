"""Packet analytics as Spark DataFrame plans."""
