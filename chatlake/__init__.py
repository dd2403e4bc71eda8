"""Analytics and retrieval over workspace-chat data, as functions from DataFrames to DataFrames."""
