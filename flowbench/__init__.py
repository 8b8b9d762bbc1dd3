"""Spark jobs over large collections of diagram graphs."""
