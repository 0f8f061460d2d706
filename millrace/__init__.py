"""Millrace: spreadsheet submissions to reconciled sales marts, as Spark plans."""

__version__ = "0.1.0"
