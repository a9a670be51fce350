"""Readers and writers: tables, entity files, triples, citation networks, ontologies, graphs, registries."""
