"""Composed jobs and distributed building blocks shared by the operators."""
