"""Web-security event analytics as Spark jobs.

Every public function takes DataFrames and returns a DataFrame; paths, clocks
and limits are arguments. See README.md for the tour.
"""
