"""Context/query plans, splits and normalisation."""
