"""Texts to syntax trees: lexer, expressions, SQL statements, filters; and trees to text."""
