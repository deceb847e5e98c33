"""govlens: rubric-driven catalog-governance analytics on Spark DataFrames.

Layers:
  sources    raw catalog rows (CSV, fixture adapter), reference dimensions
  functions  Column-level helpers (string cleanup, keys, rubric compiler, labels)
  operators  DataFrame -> DataFrame steps (silver, gold roll-ups, structure,
             gaps, access, alerts, feedback)
  plans      pipeline composition, semantic layer (measures, filters, questions)
  streaming  incremental bronze/silver with Structured Streaming
"""

__version__ = "0.1.0"
