"""Spark-native analytics over timetable events: normalising, resolving, de-duplicating, auditing."""

__version__ = "0.1.0"
