"""Transformations of allele, sample and trace tables."""
