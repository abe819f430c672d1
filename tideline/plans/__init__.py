"""Whole analyses made of operators, reports, views and the command line."""
