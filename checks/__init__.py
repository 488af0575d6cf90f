"""Inputs and reference SQL of the registered queries."""
