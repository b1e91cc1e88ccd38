"""Connectivity recovery for technical drawings as lazy, page-keyed DataFrame operators."""
