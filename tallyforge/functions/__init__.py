"""Expressions shared by the operators: ``text``, ``variant`` and ``numbers``."""
