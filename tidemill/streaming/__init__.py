"""Stateful forms and runners for streams."""
