"""Registered queries over the fixture tables, each with its SQL twin."""
