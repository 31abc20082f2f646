"""Tables, files and logs as DataFrames."""
