"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom import dims

from .url import stripped


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def squeezed(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(or_empty(c), r"\s+", " "))


def untagged(c: Column, gap: str = " ") -> Column:
    """Without markup; ``gap`` stands where a tag was (with an empty gap, words may run together)."""
    return squeezed(F.regexp_replace(or_empty(c), "<[^>]+>", gap))


def article_text(title: Column, description: Column, url: Column | None = None, most: int | None = None, tags: bool = True) -> Column:
    """Title, full stop, description cut to ``most`` characters; the one that there is, else the URL."""
    t = stripped(or_empty(title))
    d = untagged(description) if tags else squeezed(description)
    d = F.left(d, F.lit(most)) if most else d
    last = stripped(or_empty(url)) if url is not None else F.lit("")
    return F.when((t != "") & (d != ""), F.concat(t, F.lit(". "), d)).when(t != "", t).when(d != "", d).otherwise(last)


def embedding_text(title: Column, description: Column, compat: bool = True) -> Column:
    """Text that article vectors are made of. ``compat``: a null reads None, as it always has."""
    word = F.lit("None" if compat else "")
    return F.concat(F.coalesce(title, word), F.lit(" "), F.coalesce(description, word))


def prompt_line(title: Column, description: Column) -> Column:
    return F.concat(stripped(F.left(or_empty(title), F.lit(200))), F.lit(". "), stripped(F.left(or_empty(description), F.lit(300))))


def capitals(c: Column) -> Column:
    """A capital at the start and after whatever is no letter, small letters elsewhere."""
    apart = F.regexp_replace(F.lower(c), r"([^\p{Lu}\p{Ll}\p{Lt}])", "$1\u0001 ")
    return F.replace(F.initcap(apart), F.lit("\u0001 "), F.lit(""))


def title_case(label: Column) -> Column:
    """Capitals, and hyphens become blanks."""
    return F.replace(capitals(label), F.lit("-"), F.lit(" "))


def canonical_label(raw: Column) -> Column:
    """A known label in canonical form, another in title case; null and empty are Unknown."""
    known = F.create_map(*[F.lit(x) for kv in dims.LABELS.items() for x in kv])
    found = F.try_element_at(known, F.lower(stripped(raw)))
    return F.when(raw.isNull(), "Unknown").otherwise(F.coalesce(found, capitals(raw)))


def tokens(c: Column, stop: list[str], least: int = 3) -> Column:
    """Words of a-z and 0-9 in order, of ``least`` characters, outside ``stop``."""
    plain = F.regexp_replace(F.lower(or_empty(c)), r"[^a-z0-9\s]+", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) >= least) & ~w.isin(stop))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y)))


def words(c: Column) -> Column:
    return F.filter(F.split(or_empty(c), r"\s+"), lambda w: w != "")


def headline_query(c: Column, most: int = 6) -> Column:
    """Without numbers and punctuation, the first ``most`` words."""
    plain = F.regexp_replace(F.regexp_replace(or_empty(c), r"\b\d+%?\b", " "), r"[^A-Za-z0-9\s\-]", " ")
    return F.array_join(F.slice(words(plain), 1, most), " ")


def image_query(title: Column, summary: Column, most: int = 12) -> Column:
    """Words of the title, then up to five telling words of the summary; the summary's first sentence stands in for a title."""
    t, s = stripped(or_empty(title)), stripped(or_empty(summary))
    t = F.when(t == "", stripped(F.regexp_extract(s, r"^([^.!?]*)", 1))).otherwise(t)
    clean = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^[ .,:;–-]+|[ .,:;–-]+$", "")
    own = F.transform(F.regexp_extract_all(clean, F.lit(r"([A-Za-z0-9]+)"), 1), F.lower)
    # Lambdas see the title's words as an array made once for a row, and what stands outside them is made once too.
    telling = _once(own, lambda seen: F.filter(tokens(s, dims.QUERY_STOP, 4), lambda w: ~F.array_contains(seen, w)))
    return F.when(t == "", "").otherwise(F.array_join(F.slice(F.concat(words(clean), F.slice(telling, 1, 5)), 1, most), " "))


def distinct_queries(*queries: Column) -> Column:
    """Those that aren't empty, each once, in order."""
    return F.array_distinct(F.filter(F.array(*queries), lambda q: q != ""))


def short_queries(title: Column, headline: Column) -> Column:
    plain = F.regexp_replace(or_empty(headline), r"[\(\)\[\]\{\}]", " ")
    return distinct_queries(squeezed(title), headline_query(plain, 8))


def entity_query(headline: Column, most: int = 4) -> Column:
    """Capitalised words outside the stop list, or the first such words where there are fewer than two."""
    found = F.regexp_extract_all(or_empty(headline), F.lit("([A-Za-z0-9']+)"), 1)
    telling = F.filter(found, lambda w: ~F.lower(w).isin(dims.ENTITY_STOP))
    bare = lambda w: F.regexp_replace(w, "^'+|'+$", "")
    named = F.transform(F.filter(telling, lambda w: F.rlike(w, F.lit("^[A-Z]"))), bare)
    return F.array_join(F.slice(F.when(F.size(named) >= 2, named).otherwise(F.transform(telling, bare)), 1, most), " ")


def entities(c: Column) -> Column:
    """Offline stand-in for named entities: capitalised words outside the stop list, in lower case, each once."""
    found = F.regexp_extract_all(or_empty(c), F.lit("([A-Z][A-Za-z0-9]+)"), 1)
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda w: ~w.isin(dims.ENTITY_STOP)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value made once for a row, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def top_tokens(words_: Column, most: int) -> Column:
    """The most frequent words of an array, ties in alphabetical order: lengths of runs in the sorted words."""

    def ranked(ordered: Column) -> Column:
        size = F.size(ordered)
        begins = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))

        def best(starts: Column) -> Column:
            runs = F.transform(starts, lambda at, k: F.struct((at - F.coalesce(F.get(starts, k + 1), size + 1)).alias("n"), F.get(ordered, at - 1).alias("w")))
            return F.transform(F.slice(F.array_sort(runs), 1, most), lambda s: s["w"])

        return F.when(size == 0, F.array().cast("array<string>")).otherwise(_once(begins, best))

    return _once(F.array_sort(words_), ranked)


def photo_queries(query: Column, topic: Column, headline: Column, most: int = 5) -> Column:
    """The query, the headline's telling words, the topic's most frequent words."""
    second = F.array_join(F.slice(tokens(headline, dims.IMAGE_STOP), 1, most), " ")
    third = F.array_join(top_tokens(tokens(topic, dims.IMAGE_STOP), most), " ")
    return distinct_queries(stripped(or_empty(query)), second, third)


def relevance(query: Column, title: Column, description: Column) -> Column:
    """Words of the query that stand in title or description."""
    own = lambda c: F.array_distinct(tokens(c, dims.RELEVANCE_STOP))
    return F.size(F.array_intersect(own(query), F.array_union(own(title), own(description))))


def reply_headline(reply: Column) -> Column:
    """The first line that begins with ``headline:`` in any case; only the exact word is taken off."""
    line = F.regexp_extract(or_empty(reply), r"(?im)^(headline:[^\r\n]*)", 1)
    return F.when(line == "", "Untitled").otherwise(stripped(F.replace(line, F.lit("Headline:"), F.lit(""))))


def reply_body(reply: Column, compat: bool = True) -> Column:
    """What stands between ``Summary:`` and ``Takeaways:``; the whole reply if there isn't exactly one of the latter.

    ``compat``: letters K, e and y at its end are lost, as they always were.
    """
    parts = F.split(or_empty(reply), "Takeaways:")
    body = stripped(F.substring_index(F.try_element_at(parts, F.lit(1)), "Summary:", -1))
    body = F.regexp_replace(body, "[Key]+$", "") if compat else body
    return stripped(F.when(F.size(parts) == 2, body).otherwise(or_empty(reply)))


def reply_takeaways(reply: Column) -> Column:
    parts = F.split(or_empty(reply), "Takeaways:")
    lines = F.filter(F.split(stripped(F.try_element_at(parts, F.lit(2))), r"\r?\n"), lambda x: stripped(x) != "")
    return F.when(F.size(parts) == 2, F.transform(lines, lambda x: stripped(F.regexp_replace(x, "^[- ]+|[- ]+$", "")))).otherwise(F.array().cast("array<string>"))


def reply_event(reply: Column) -> Column:
    """Label and reason of an event judgement; keywords of the first line where no valid label is given."""
    clean = F.filter(F.transform(F.split(stripped(or_empty(reply)), r"\r?\n"), stripped), lambda x: x != "")
    after = lambda key: F.try_element_at(F.transform(F.filter(clean, lambda x: F.startswith(F.lower(x), F.lit(key))), lambda x: stripped(F.regexp_replace(x, "^[^:]*:", ""))), F.lit(-1))
    label, first = F.upper(after("label:")), F.upper(or_empty(F.try_element_at(clean, F.lit(1))))
    guess = F.when(F.contains(first, F.lit("THEMATIC")), "THEMATIC_BUCKET").when(F.contains(first, F.lit("MIXED")), "MIXED").otherwise("SINGLE_EVENT")
    label = F.when(label.isin("SINGLE_EVENT", "MIXED", "THEMATIC_BUCKET"), label).otherwise(guess)
    return F.struct(label.alias("label"), F.coalesce(F.nullif(after("why:"), F.lit("")), F.lit("OK")).alias("why"))


def reply_specific(reply: Column) -> Column:
    """Whether an older judge's first line says a specific event, and what it says after it."""
    lines = F.split(stripped(or_empty(reply)), r"\r?\n")
    first = F.lower(stripped(F.get(lines, F.lit(0))))
    rest = stripped(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), " "))
    return F.struct(F.startswith(first, F.lit("type: specific")).alias("specific"), rest.alias("why"))


def chip(url: Column, bias: Column, source_name: Column) -> Column:
    """Anchor of one source. URL and name are escaped."""
    label = title_case(F.coalesce(F.nullif(bias, F.lit("")), F.lit("Unknown")))
    label = F.when(label.isin(dims.LABEL_ORDER), label).otherwise("Unknown")
    colour = F.create_map(*[F.lit(x) for kv in dims.COLOURS.items() for x in kv])[label]
    safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    link = F.coalesce(url, F.lit("#"))
    name = F.coalesce(F.nullif(source_name, F.lit("")), F.substring_index(F.substring_index(link, "//", -1), "/", 1))
    return F.concat(F.lit('<a href="'), safe(link), F.lit('" target="_blank" class="chip" style="background-color: '), colour, F.lit("33; border-color: "), colour, F.lit(';">'), safe(name), F.lit("</a>"))


def short_credit(credit: Column, most: int = 80) -> Column:
    """A credit line cut to ``most`` characters, with an ellipsis where it was longer."""
    return F.when(F.length(credit) > most, F.concat(F.rtrim(F.left(credit, F.lit(most))), F.lit("…"))).otherwise(credit)


def cache_key(model: str, text: Column) -> Column:
    return F.concat(F.lit(f"{model}:"), F.sha2(text, 256))


def budget(text: Column, tokens_: int, per_token: int = 4) -> Column:
    """Offline stand-in for a token limit: so many characters for each token."""
    return F.left(or_empty(text), F.lit(tokens_ * per_token))
