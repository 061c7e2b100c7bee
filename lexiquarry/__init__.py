"""Lexiquarry: exact and soft phrase search over large text corpora, as Spark plans."""
