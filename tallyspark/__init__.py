"""Ballot-results analytics as Spark DataFrame operators."""
