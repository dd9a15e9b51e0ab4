"""pageloom: tables of web pages and extraction requests in, structured records out.

Every function takes and returns DataFrames (operators) or Columns (scalar rules); nothing is
collected to the driver unless the docstring says so.
"""
