"""Registered queries of the operators, each with SQL that gives the same rows."""
