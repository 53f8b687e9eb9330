"""Text operators for training-data work. Nothing outside this folder imports it."""
