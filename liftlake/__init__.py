"""liftlake: activity-log analytics written as Spark DataFrame operators.

Layers:
  sources/    scans of the raw tables, adapter views, sinks and the upsert writer
  functions/  scalar column helpers (names, rounding, dates, labels)
  operators/  generic, column-parameterised DataFrame operators
  plans/      the mart models, report queries, notification plans, ML and jobs
  streaming/  micro-batch document sync on Structured Streaming
"""

__all__ = ["session"]
