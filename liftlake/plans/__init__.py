"""Composed plans: mart models, report queries, notification plans, ML, jobs."""
