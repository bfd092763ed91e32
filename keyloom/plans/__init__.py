"""Planned computations over stored variables."""
