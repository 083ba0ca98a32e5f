"""Spark jobs over corpora of solicitation documents."""
