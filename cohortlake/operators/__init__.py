"""Operators over DataFrames; each module names the tables that it works on."""
