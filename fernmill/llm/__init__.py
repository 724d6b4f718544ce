"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it. Each module holds one operator with
its own interface; ``queries`` holds the thin registered queries over them.
"""
