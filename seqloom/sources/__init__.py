"""Readers with declared schemas and checks, and staged writers."""
