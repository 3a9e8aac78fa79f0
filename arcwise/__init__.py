"""Graph analytics on Spark: graphs are vertex and edge DataFrames."""
