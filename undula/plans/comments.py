"""Comments of a signal: lines, often as NAME=value."""

from __future__ import annotations


def appended(comments: list[str], text: str) -> list[str]:
    """With one more comment for each line of the text."""
    return [*comments, *text.splitlines()] if text else list(comments)


def find(comments: list[str], name: str) -> str | None:
    """The value of the first NAME=value of that name, in any case."""
    for c in comments:
        key, sign, value = c.partition("=")
        if sign and key.strip().lower() == name.lower():
            return value
    return None


def joined(comments: list[str]) -> str:
    return "\n".join(comments)
