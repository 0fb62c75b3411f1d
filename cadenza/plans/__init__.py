"""Whole analyses, composed from operators in their fixed order."""
