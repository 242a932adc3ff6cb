"""Operators on DataFrames: spectra, ranks, mutants, results, evaluation, selection."""
