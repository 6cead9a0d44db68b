"""Operators for large-scale training-data preparation. Nothing else in docloom imports this."""
