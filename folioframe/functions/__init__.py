"""Folioframe functions."""
