"""plumbline: tables of requests, documents, predictions and replies on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or Column). Nothing here collects data
to the driver; a function that needs an action to choose a join strategy says so in its docstring.
"""
