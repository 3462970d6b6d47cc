"""Relational operators: cleaning, views, base queries and the analyses built on them."""
