"""Registered queries over the driver tables and end-to-end cycles."""
