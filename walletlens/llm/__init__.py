"""Operators for training-data pipelines over document tables. Nothing else imports this package."""
