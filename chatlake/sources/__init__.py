"""Inputs: chat-shaped views of the given tables, event files, exports."""
