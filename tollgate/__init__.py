"""tollgate: governance analytics over LLM gateway traffic, expressed as Spark jobs.

Every public function takes and returns DataFrames (or Columns); nothing holds
state between calls.  See README.md for the module map.
"""

__all__ = ["config", "schemas", "session"]
