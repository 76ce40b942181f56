"""Providers that call models and searches over HTTP, with retries. Each is given its address and key; none is a default.

``post`` and ``get`` are functions, so that tests, proxies and other clients can stand in for the network.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Sequence
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import numpy as np


def post(url: str, body: dict, key: str, timeout: float = 60) -> dict:
    request = Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urlopen(request, timeout=timeout) as reply:
        return json.loads(reply.read())


def get(url: str, headers: dict[str, str], timeout: float = 8) -> str:
    with urlopen(Request(url, headers=headers), timeout=timeout) as reply:
        return reply.read().decode("utf-8", "replace")


def retried(call: Callable[[], object], attempts: int = 5, least: float = 1.5, most: float = 3.5, sleep: Callable[[float], None] = time.sleep):
    """The call's result, or None after ``attempts`` failures; waits grow with each attempt."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except (URLError, OSError, ValueError, KeyError, IndexError, TypeError):
            if attempt < attempts:
                sleep(random.uniform(least, most) * attempt)
    return None


class ApiEmbedder:
    """Vectors of an embeddings endpoint. A text that fails is the zero vector, which isn't cached."""

    def __init__(self, url: str, key: str, model: str, dims: int = 1536, most_chars: int = 28_000, post: Callable = post, sleep: Callable = time.sleep):
        self.name, self.dims = f"api-{model}", dims
        self._url, self._key, self._model, self._most, self._post, self._sleep = url, key, model, most_chars, post, sleep

    def _one(self, text: str) -> list[float]:
        got = retried(lambda: self._post(self._url, {"model": self._model, "input": text[: self._most]}, self._key)["data"][0]["embedding"], sleep=self._sleep)
        return got if got is not None and len(got) == self.dims else [0.0] * self.dims

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        return np.array([self._one(t or "") for t in texts], np.float32).reshape(len(texts), self.dims)


class _Chat:
    def __init__(self, url: str, key: str, model: str, post: Callable = post, sleep: Callable = time.sleep):
        self.name = f"chat-{model}"
        self._url, self._key, self._model, self._post, self._sleep = url, key, model, post, sleep

    def _ask(self, system: str, user: str, most_tokens: int) -> str | None:
        body = {"model": self._model, "temperature": 0.2, "max_tokens": most_tokens, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        return retried(lambda: self._post(self._url, body, self._key)["choices"][0]["message"]["content"].strip(), attempts=3, sleep=self._sleep)


class ChatJudge(_Chat):
    """Whether titles tell of one event; without an answer they are taken to."""

    SYSTEM = "You check groups of news headlines. Answer in two lines: 'Label: SINGLE_EVENT', 'Label: MIXED' or 'Label: THEMATIC_BUCKET', then 'Why: ' and a short reason."

    def label(self, titles: Sequence[str]) -> str:
        listed = "\n".join(f"- {t}" for t in titles if t)
        return self._ask(self.SYSTEM, f"Do these headlines tell of one event?\n{listed}", 60) or "Label: SINGLE_EVENT\nWhy: no answer"


class ChatEventCheck(_Chat):
    """The older judge's question; without an answer titles are taken to tell of one event."""

    SYSTEM = "You check groups of news headlines. Answer 'Type: Specific Event', 'Type: Mixed' or 'Type: Thematic Similarity' in the first line, then a short reason."

    def check(self, titles: Sequence[str]) -> str:
        return self._ask(self.SYSTEM, "\n".join(titles), 80) or "Type: Specific Event\nno answer"


class ChatNewsDesk(_Chat):
    """A topic's news from a search: found, put together, summarised; each step reads the one before it."""

    STEPS = ("Put these reports together into one account, without repeating what they share.", "Summarise this account in a few neutral sentences.")

    def tell(self, topic: str, search: Callable[[str], list[dict]]) -> list[str]:
        found = search(f"{topic} news")[:3]
        if not found:
            return [f"No news found for {topic}."]
        told = ["\n\n".join(f"{r['title']}\n{r['url']}\n{r['text']}" for r in found)]
        for step in self.STEPS:
            told.append(self._ask(step, told[-1], 700) or told[-1])
        return told


class ChatSummarizer(_Chat):
    """Headline, summary and takeaways of a topic's articles; None without an answer."""

    SYSTEM = "You summarise news neutrally. Answer with a line 'Headline: ...', then 'Summary: ' and one paragraph, then 'Takeaways:' and three lines that begin with '- '."

    def summarize(self, articles: Sequence[tuple[str, str]]) -> str | None:
        listed = "\n".join(f"{(t or '')[:200].strip()}. {(d or '')[:300].strip()}" for t, d in articles)
        return self._ask(self.SYSTEM, listed, 700) if listed.strip() else None


class _Search:
    def __init__(self, get: Callable = get):
        self._get = get

    def _reply(self, url: str, parameters: dict, headers: dict[str, str]) -> str | None:
        return retried(lambda: self._get(f"{url}?{urlencode(parameters)}", headers), attempts=1)


class EncyclopediaSearch(_Search):
    """Files of a MediaWiki site, with licence and credit."""

    def __init__(self, url: str = "https://commons.wikimedia.org/w/api.php", agent: str = "topicloom/1", get: Callable = get):
        super().__init__(get)
        self.name, self._url, self._agent = "encyclopedia-1", url, agent

    def search(self, query: str) -> str | None:
        wanted = {"action": "query", "generator": "search", "gsrsearch": query, "gsrnamespace": 6, "gsrlimit": 10, "prop": "imageinfo", "iiprop": "url|extmetadata", "iiurlwidth": 600, "format": "json"}
        return self._reply(self._url, wanted, {"User-Agent": self._agent}) if query else None


class PhotoSearch(_Search):
    """Photos of a search API with a client id."""

    def __init__(self, key: str, url: str = "https://api.unsplash.com/search/photos", get: Callable = get):
        super().__init__(get)
        self.name, self._url, self._key = "photos-1", url, key

    def search(self, query: str) -> str | None:
        return self._reply(self._url, {"query": query, "per_page": 8, "orientation": "landscape"}, {"Authorization": f"Client-ID {self._key}"}) if query else None


#: What a day's articles are asked for by.
NEWS_WORDS = ("politics", "war", "elections", "protest", "conflict", "economy")


def news_reply(key: str, date: str | None = None, rows: int = 100, url: str = "https://newsapi.org/v2", get: Callable = get) -> str:
    """A news API's reply for a day, or without one its top headlines; an empty object where it fails, which has no rows."""
    wanted = {"language": "en", "pageSize": rows}
    if date:
        wanted |= {"q": " OR ".join(NEWS_WORDS), "sortBy": "publishedAt", "from": date, "to": date}
    return retried(lambda: get(f"{url}/{'everything' if date else 'top-headlines'}?{urlencode(wanted)}", {"X-Api-Key": key}), attempts=1) or "{}"
