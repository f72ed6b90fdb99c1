"""Folioworks: an archive analytics engine written as Spark DataFrames."""
