"""Training-data operators over converted documents. Nothing outside this folder imports it."""
