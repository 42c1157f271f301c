"""Answers that a person types, read the same way in every language of the interface."""

from __future__ import annotations

import re

from tamis.functions.text import FOLD_FROM, FOLD_TO

# What counts as yes and no.
YES = {"y", "yes", "بله", "آری", "آره", "اره"}
POLICY_WORDS = {"strict": ("1", "strict", "سخت‌گیرانه", "سختگیرانه"), "open": ("2", "open", "آزاد", "باز")}
SOURCE_WORDS = {"file": ("1", "file", "فایل", "فایل محلی"), "url": ("2", "url", "وب", "سایت", "آدرس", "لینک")}
#: This project's own: what counts as no.
NO = {"n", "no", "نه", "خیر"}
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def plain(answer: str) -> str:
    return re.sub(r"\s+", " ", answer.translate(_FOLD)).strip().lower()


def yes_or_no(answer: str) -> bool | None:
    """True, False, or None where it is neither."""
    a = plain(answer)
    return True if a in YES else False if a in NO else None


def _choice(answer: str, words: dict[str, tuple[str, ...]]) -> str | None:
    a = plain(answer)
    return next((name for name, own in words.items() if a in own), None)


def choose_policy(answer: str, current: str) -> str | None:
    """A policy by name, word or number; an empty answer keeps the current one, an unknown one gives None."""
    return _choice(answer, POLICY_WORDS) if plain(answer) else current


def choose_source(answer: str) -> str | None:
    """file or url, or None where it is neither."""
    return _choice(answer, SOURCE_WORDS)
