"""Partition transforms and sort orders as Catalyst columns."""
