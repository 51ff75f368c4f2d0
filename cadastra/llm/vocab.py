"""Where the public vocabulary files are. They are read from their installed place, never copied."""

from __future__ import annotations


def vocabulary(name: str) -> str:
    """Path of a vocabulary file; every operator takes such a path as a parameter."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
