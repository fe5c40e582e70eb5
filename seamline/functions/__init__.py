"""Subpackage; see the README for what lives here."""
