"""Whole audits built from the operators."""
