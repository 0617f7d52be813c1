"""Distributed operators: schema drift, hierarchies, nested records, graph matching."""
