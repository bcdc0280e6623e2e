"""Relational operators: each module builds DataFrame plans for one family."""
