"""Whole evaluations and jobs."""
