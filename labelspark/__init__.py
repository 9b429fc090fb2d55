"""labelspark: zero-shot text-classification data work as Spark DataFrame jobs.

Subpackages:
  functions  - Column expressions (text, hashing randomness, vectors, activations)
  operators  - DataFrame -> DataFrame operators (normalisers, sampling, pairs,
               packing, pooling, scoring, metrics, losses, annotation)
  sources    - readers and sinks
  plans      - the registered queries bound to the given tables, with oracle SQL
  streaming  - file-stream runner for the row-local operators
"""

__version__ = "0.1.0"
