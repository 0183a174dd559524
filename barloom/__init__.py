"""Barloom: point-in-time research analytics over bars, facts, news and events, written as Spark plans."""
