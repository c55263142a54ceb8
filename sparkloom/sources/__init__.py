"""Readers. Each returns a DataFrame; nothing is read on the driver but schemas and file names."""
