"""Folioframe plans."""
