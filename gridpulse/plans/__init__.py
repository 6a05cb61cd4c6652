"""Compositions: the staged run, and the registered queries with their SQL counterparts."""
