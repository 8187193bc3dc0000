"""Training-data operators. Nothing outside this subpackage imports it.

Every operator module keeps a general interface (DataFrame in, DataFrame out, parameters as
arguments); `registry` holds the thin queries the driver runs and their SQL.
"""
