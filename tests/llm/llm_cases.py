"""Shared fixtures: small tables with every odd case."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng: random.Random, n: int, words: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_documents(rng: random.Random) -> list[tuple]:
    """Null text, id, source; empty and blank texts; one word; a very long text; repeated rows and texts."""
    long = sentence(rng, 30_000)
    again = sentence(rng, 80)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, "word", "en", None, 4), (None, sentence(rng, 60), "en", "a", 9),
        (5, long, "en", "a", 9), (6, again, "en", "b", 9), (6, again, "en", "b", 9), (7, again, "fr", "b", 9), (8, "ÀÉ ß 漢字 🙂 " * 20, "de", "b", 9),
    ]
    return rows


def spread(frame, rows: list[tuple], ddl: str = DOCS, parts: int = 3):
    return frame(rows, ddl).repartition(parts)
