"""Readers that give relations."""
