"""How a tokenized text is read as terms."""

from __future__ import annotations

import unicodedata


def terms_of(text: str | None) -> list[str]:
    """Pieces between Unicode white space after NFC and lower-casing; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return text.lower().split()


def term_of(word: str | None) -> str | None:
    """A vocabulary word read the same way; null where nothing is left of it."""
    return " ".join(terms_of(word)) or None
