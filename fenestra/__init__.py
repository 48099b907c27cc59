"""Checks of windowed letters and registered-mail labels, in bulk, on Spark."""
