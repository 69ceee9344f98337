"""Compositions: input views over the driver tables and the end-to-end plans."""
