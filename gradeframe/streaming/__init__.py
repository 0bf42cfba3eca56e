"""The same work over arriving files."""
