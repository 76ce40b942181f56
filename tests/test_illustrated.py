"""Pictures of topics and the providers that are called over HTTP, with stand-ins for the network."""

import json

import numpy as np
import pytest

from topicloom import providers, providers_http
from topicloom.plans import illustrated

LICENSE = {"LicenseShortName": {"value": "CC BY"}, "Artist": {"value": "<b>Ann</b>"}}


class Wiki:
    """A castle under the second query only; a scan and an unlicensed file under the first."""

    name = "wiki"

    def search(self, query):
        page = lambda title, url, more, text="red castle on a hill": {"title": title, "imageinfo": [{"thumburl": url, "descriptionurl": "d", "extmetadata": more | {"ImageDescription": {"value": text}}}]}
        if query == "Red Castle Hill":
            return json.dumps({"query": {"pages": {"1": page("Red castle hill.pdf", "https://w/x.pdf", LICENSE), "2": page("Red castle hill", "https://w/n.jpg", {})}}})
        if query == "Red Castle Hill opens again":
            return json.dumps({"query": {"pages": {"5": page("Red castle hill", "https://w/5.jpg", LICENSE), "6": page("Other", "https://w/6.jpg", LICENSE, "nothing alike here")}}})
        return None


class Photos:
    name = "photos"

    def search(self, query):
        return json.dumps({"results": [{"urls": {"raw": "https://p/1"}, "alt_description": "Harbour strike goes on", "user": {"name": "Bo"}, "links": {"html": "h"}}, {"urls": {"small": "https://p/2"}, "alt_description": "a cat"}]}) if "arbour" in query else "no json"


def test_pictures_by_provider_and_query(spark):
    rows = [(1, "Red Castle Hill opens again", "Red castle on a hill opens.", "Castle opens"), (2, "Harbour strike goes on", "Harbour strike goes on.", "Harbour strike goes on"), (3, "quiet day", "nothing", None)]
    topics = spark.createDataFrame(rows, "cluster_id long, topic_title string, summary string, central string")
    got = {r["cluster_id"]: r for r in illustrated.illustrated(topics, providers.HashingEmbedder(256), Wiki(), Photos()).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["url"], got[1]["source"], got[1]["credit"], got[1]["license"]) == ("https://w/5.jpg", "wikimedia", "Photo: Ann / Wikimedia Commons / CC BY", "CC BY")
    assert (got[2]["url"], got[2]["source"], got[2]["credit"]) == ("https://p/1&w=900&fit=max&q=80", "unsplash", "Photo: Bo / Unsplash")
    assert illustrated.illustrated(topics, providers.HashingEmbedder(256), None, None).count() == 0
    assert illustrated.illustrated(topics.limit(0), providers.HashingEmbedder(256), Wiki(), None).count() == 0


def test_retries_grow_and_end():
    waits, calls = [], []

    def fails(url, body, key):
        calls.append(body["input"])
        raise OSError("no network")

    own = providers_http.ApiEmbedder("u", "k", "m", dims=3, most_chars=4, post=fails, sleep=waits.append)
    assert own.encode(["long text"]).tolist() == [[0.0] * 3]
    assert calls == ["long"] * 5 and len(waits) == 4 and all(1.5 * k <= w <= 3.5 * k for k, w in enumerate(waits, 1))
    fine = providers_http.ApiEmbedder("u", "k", "m", dims=2, post=lambda *_: {"data": [{"embedding": [1.0, 2.0]}]}, sleep=waits.append)
    assert np.array_equal(fine.encode(["a", None]), [[1, 2], [1, 2]])


def test_chat_providers():
    said = []

    def post(url, body, key):
        said.append((url, key, body["messages"][-1]["content"]))
        return {"choices": [{"message": {"content": " Label: MIXED\nWhy: two \n"}}]}

    assert providers_http.ChatJudge("u", "k", "m", post=post).label(["a", "", "b"]) == "Label: MIXED\nWhy: two"
    assert said[0][:2] == ("u", "k") and said[0][2].endswith("- a\n- b")
    broken = providers_http.ChatSummarizer("u", "k", "m", post=lambda *_: {}, sleep=lambda _: None)
    assert broken.summarize([("t", "d")]) is None and broken.summarize([]) is None
    assert providers_http.ChatJudge("u", "k", "m", post=lambda *_: {}, sleep=lambda _: None).label(["a"]).startswith("Label: SINGLE_EVENT")


@pytest.mark.parametrize("date", [None, "2024-01-10"])
def test_requests(date):
    asked = []

    def get(url, headers):
        asked.append((url, headers))
        return "{}"

    providers_http.news_reply("key", date, rows=5, get=get)
    providers_http.EncyclopediaSearch(get=get).search("red castle")
    providers_http.PhotoSearch("id", get=get).search("red castle")
    assert providers_http.PhotoSearch("id", get=get).search("") is None and len(asked) == 3
    assert asked[0][1] == {"X-Api-Key": "key"} and ("from=2024-01-10" in asked[0][0]) == bool(date) and "pageSize=5" in asked[0][0]
    assert "gsrsearch=red+castle" in asked[1][0] and asked[2][1] == {"Authorization": "Client-ID id"}

    def broken(url, headers):
        raise OSError

    assert providers_http.news_reply("key", get=broken) == "{}" and providers_http.EncyclopediaSearch(get=broken).search("q") is None


def test_news_desk_passes_on_each_step():
    post = lambda url, body, key: {"choices": [{"message": {"content": body["messages"][0]["content"].split()[0] + ": " + body["messages"][1]["content"][:5]}}]}
    desk = providers_http.ChatNewsDesk("u", "k", "m", post=post)
    found = desk.tell("strike", lambda q: [{"title": q, "url": "u", "text": "t"}] * 5)
    assert found[0].count("strike news") == 3 and found[1:] == ["Put: strik", "Summarise: Put:"]
    assert desk.tell("x", lambda q: []) == ["No news found for x."]
    assert providers_http.ChatEventCheck("u", "k", "m", post=lambda *_: {}, sleep=lambda _: None).check(["a"]).startswith("Type: Specific")
