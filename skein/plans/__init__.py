"""Registered queries: importing the modules fills skein.registry."""
