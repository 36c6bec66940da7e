"""binomia: reconcile free-text names with a catalogue of identifiers, on Spark.

Operators take and return DataFrames or Columns. Those that need a size, a fixed point or a table that
several steps read run jobs: match_names, matched_rows, map_names, compile_taxonomy, the sinks and the
command line. All others stay lazy.
"""
