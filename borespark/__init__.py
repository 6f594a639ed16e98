"""Drilling-data and risk analytics as DataFrame operators."""
