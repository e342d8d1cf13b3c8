"""stmtlens: auditing of database access at scale, expressed as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing runs until the caller triggers an action.
"""
