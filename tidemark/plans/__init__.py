"""Whole detectors as parameterisations of the operators, and the registered queries."""
