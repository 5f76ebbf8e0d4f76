"""Audit, deduplication, curation and evaluation of annotated detection datasets on Spark."""
