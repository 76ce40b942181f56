"""External models behind small protocols, each with an offline default that gives the same answer everywhere.

A provider's name and version are part of the keys under which its answers are cached. ``None`` in place of a provider
takes the operator's fail-open branch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from typing import Protocol

import numpy as np

from topicloom import dims


class Embedder(Protocol):
    name: str
    dims: int

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


class Judge(Protocol):
    name: str

    def label(self, titles: Sequence[str]) -> str: ...


class Summarizer(Protocol):
    name: str

    def summarize(self, articles: Sequence[tuple[str, str]]) -> str | None: ...


class ZeroShot(Protocol):
    name: str

    def score(self, text: str, labels: Sequence[str]) -> list[float]: ...


class ImageSearch(Protocol):
    name: str

    def search(self, query: str) -> str | None: ...


_WORD = re.compile(r"\w+")


class HashingEmbedder:
    """Bag of hashed words, unit length; a text without words is the zero vector."""

    def __init__(self, dims_: int = 384):
        self.name, self.dims = f"hashing-{dims_}-1", dims_

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for row, text in enumerate(texts):
            for word in _WORD.findall((text or "").lower()):
                digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
                h = int.from_bytes(digest, "little")
                out[row, (h >> 1) % self.dims] += 1 if h & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32)


class FixedJudge:
    """Every topic is one event."""

    name = "fixed-1"

    def label(self, titles: Sequence[str]) -> str:
        return "Label: SINGLE_EVENT\nWhy: offline"


class ExtractiveSummarizer:
    """The first title as headline, first sentences as summary, further titles as takeaways."""

    name = "extractive-1"

    def summarize(self, articles: Sequence[tuple[str, str]]) -> str | None:
        if not articles:
            return None
        first = [re.split(r"(?<=[.!?])\s", d or t or "")[0] for t, d in articles[:3]]
        points = [t for t, _ in articles[1:4] if t]
        return f"Headline: {articles[0][0]}\nSummary: {' '.join(first)}\nTakeaways:\n" + "\n".join(f"- {p}" for p in points)


class KeywordZeroShot:
    """Shares by the words of each label that stand in the text, each counted once more than it occurs."""

    name = "keywords-1"

    def score(self, text: str, labels: Sequence[str]) -> list[float]:
        words = _WORD.findall((text or "").lower())
        raw = [1 + sum(words.count(w) for w in _WORD.findall(label.lower()) if w not in dims.IMAGE_STOP) for label in labels]
        return [r / sum(raw) for r in raw]


class NoImages:
    name = "none"

    def search(self, query: str) -> str | None:
        return None


#: Words whose share tells the language of a text, for the offline language gate.
FUNCTION_WORDS = {
    "en": {"the", "and", "of", "to", "in", "is", "that", "for", "was", "with"},
    "fr": {"le", "la", "les", "des", "et", "est", "une", "dans", "pour", "que"},
    "de": {"der", "die", "das", "und", "ist", "nicht", "mit", "ein", "den", "von"},
    "es": {"el", "los", "las", "del", "que", "una", "por", "con", "para", "es"},
}


def guess_language(text: str) -> str | None:
    """The language with most function words; null if none stands out."""
    words = _WORD.findall((text or "").lower())
    votes = sorted(((sum(w in own for w in words), lang) for lang, own in FUNCTION_WORDS.items()), reverse=True)
    return votes[0][1] if votes[0][0] > votes[1][0] else None
