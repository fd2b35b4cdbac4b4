"""Conversation analytics on PySpark: annotation sources, interval algebra, carry
windows, text metrics, scoring, statistics and training-data operators."""
