"""Operators over tables: joins in time and space, sequences, sums, changes and solvers."""
