"""Readers and writers: field tables, band metadata text, per-fold stores."""
