"""Fixture views, registered queries with their SQL twins, and end-to-end workflows."""
