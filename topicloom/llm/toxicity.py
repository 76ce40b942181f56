"""Toxicity by a weighted finite-state grammar over the clauses of a text.

Words are read as classes (insult, suspect, harm, modal, target, negation, speech, other) by a lexicon of whole words and stems. Five
sequential transducers rewrite a clause's classes one after another; they are composed into one table of states:

* insult: an insult word becomes an insult, a suspect one a suspicion; the second of a clause counts as one more (insult, insults);
* threat: a word of harm after a modal (``REACH`` words back at most) becomes a threat, without one only a weak one;
* target: an insult or threat within ``REACH`` words of somebody it is aimed at, before or after it, is a targeted one;
* negation: one within ``REACH`` words after a negation is a negated one;
* reported speech: one after a verb of speech in its clause is a reported one.

A clause is scored by the heaviest match on its way through the table, never a word by itself; a text's log odds are a bias plus
the weights of its clauses, up to ``MOST`` of a kind. Insults beyond the fixed ones are learned as stems: beginnings of words that
stand in enough toxic sample texts and in nearly none of the others; stems that are only several times rarer there are suspects.
Weights start from fixed ones and are moved by the labels only as far as these tell (a logistic fit with a prior around them).

Fitting reads a bounded sample: at most ``toxic`` and ``clean`` texts of each label, those of the smallest id hash, whole texts of
``sample_bytes`` together (a text that doesn't fit any more is left out). Scoring reads whole texts. Defined cases: null and empty texts
have no clause and get the bias' score; rows with equal texts get equal scores; without labels, or with one only, the fixed words
and weights stand; an id with several labels counts as toxic if one says so; rows with a null label or id teach nothing; empty
tables give empty results; other columns are carried along (see ``assess``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

# Words of each class, small letters.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "asshole", "bastard", "bitch", "cretin", "dimwit", "halfwit", "scumbag", "vermin", "arschloch", "hurensohn", "trottel", "salaud", "connard", "abruti", "gilipollas", "pendejo", "cabron"]
HARM = ["kill", "hurt", "beat", "stab", "shoot", "strangle", "murder", "destroy", "töten", "umbringen", "tuer", "frapper", "matar", "golpear"]
MODALS = ["will", "gonna", "going", "shall", "should", "want", "werde", "werden", "soll", "vais", "veux", "voy", "quiero"]
TARGETS = ["you", "your", "you're", "he", "him", "she", "her", "they", "them", "their", "du", "dich", "dir", "ihr", "euch", "tu", "te", "toi", "vous", "usted", "ustedes", "ti"]
NEGATIONS = ["not", "no", "never", "isn't", "aren't", "don't", "won't", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
SPEECH = ["said", "says", "say", "wrote", "writes", "called", "calls", "claimed", "told", "quoted", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]

OTHER, INSULT, HARMFUL, MODAL, TARGET, NEGATION, SPEAKS, SUSPECT = range(8)
#: What a clause's heaviest match is; 0 is none.
KINDS = ["none", "insult", "threat", "weak threat", "targeted insult", "targeted threat", "negated insult", "negated threat", "reported insult", "reported threat", "suspicion", "insults"]
#: Fixed weights in log odds, the bias first.
PRIOR = np.array([-4.0, 6.0, 6.0, 0.5, 7.0, 8.0, 2.0, 1.0, 3.0, 2.0, 1.5, 7.5])

REACH, MOST = 4, 3

_WORD = np.ones(256, bool)
_WORD[:0x41] = _WORD[0x5B:0x61] = _WORD[0x7B:0x80] = False
_WORD[0x27] = True
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x21, 0x2E, 0x3B, 0x3F]] = True


@dataclass
class Transducer:
    """Sequential: each state has one arc for each input symbol. ``arcs[state][symbol]`` is (output symbol, weight, next state)."""

    arcs: dict[object, dict[str, tuple[str, float, object]]]
    start: object

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input; weights add up. Only reachable pairs of states are built."""
        start = (self.start, other.start)
        arcs, todo = {}, [start]
        while todo:
            state = todo.pop()
            if state in arcs:
                continue
            a, b = state
            arcs[state] = {}
            for symbol, (middle, weight, to_a) in self.arcs[a].items():
                out, more, to_b = other.arcs[b][middle]
                arcs[state][symbol] = (out, weight + more, (to_a, to_b))
                todo.append((to_a, to_b))
        return Transducer(arcs, start)

    def run(self, symbols: list[str]) -> list[tuple[str, float]]:
        state, found = self.start, []
        for symbol in symbols:
            out, weight, state = self.arcs[state][symbol]
            found.append((out, weight))
        return found


_CLASSES = ["o", "insult", "harm", "modal", "target", "negation", "speech", "suspect"]
_HITS = ["insult", "threat", "weak threat", "suspicion", "insults"]
_MARKS = ["", "targeted ", "negated ", "reported "]


def _insults() -> Transducer:
    """States: none yet, a suspect word was there, an insult was there."""
    arcs = {n: {c: (c, 0.0, n) for c in _CLASSES} for n in (0, 1, 2)}
    for n in arcs:
        arcs[n]["insult"] = ("+insults" if n == 2 else "+insult", 0.0, 2)
        arcs[n]["suspect"] = (("+suspicion", "+insult", "+insults")[n], 0.0, max(1, n))
    return Transducer(arcs, 0)


def _threats() -> Transducer:
    symbols = [c for c in _CLASSES if c not in ("insult", "suspect")] + ["+insult", "+insults", "+suspicion"]
    arcs = {n: {c: (c, 0.0, max(0, n - 1)) for c in symbols} for n in range(REACH + 1)}
    for n in arcs:
        arcs[n]["modal"] = ("o", 0.0, REACH)
        arcs[n]["harm"] = ("+threat" if n else "+weak threat", 0.0, max(0, n - 1))
    return Transducer(arcs, 0)


def _targets() -> Transducer:
    """States: words since somebody was named, or words since an untargeted hit that may still find its target."""
    arcs: dict[object, dict] = {}
    for state in [("named", n) for n in range(REACH + 1)] + [(h, n) for h in _HITS for n in range(1, REACH + 1)]:
        what, n = state
        later = ("named", max(0, n - 1)) if what == "named" or n == 1 else (what, n - 1)
        if what != "named" and n == 1:
            later = ("named", 0)
        arcs[state] = {c: (c, 0.0, later) for c in ("o", "negation", "speech")}
        # A pending hit that meets its target is told once more, as a targeted one.
        arcs[state]["target"] = ("o" if what == "named" else f"+targeted {what}", 0.0, ("named", REACH))
        for hit in _HITS:
            near = what == "named" and n > 0
            arcs[state][f"+{hit}"] = (f"+targeted {hit}", 0.0, ("named", REACH)) if near else (f"+{hit}", 0.0, (hit, REACH))
    return Transducer(arcs, ("named", 0))


def _negations() -> Transducer:
    hits = [f"+{m}{h}" for m in _MARKS[:2] for h in _HITS]
    arcs = {}
    for n in range(REACH + 1):
        arcs[n] = {c: (c, 0.0, max(0, n - 1)) for c in ("o", "speech")}
        arcs[n]["negation"] = ("o", 0.0, REACH)
        for hit in hits:
            arcs[n][hit] = (f"+negated {hit.removeprefix('+').removeprefix('targeted ')}" if n else hit, 0.0, n)
    return Transducer(arcs, 0)


def _reports() -> Transducer:
    hits = [f"+{m}{h}" for m in _MARKS[:3] for h in _HITS]
    arcs = {s: {"o": ("o", 0.0, s), "speech": ("o", 0.0, 1), **{h: (h, 0.0, s) for h in hits}} for s in (0, 1)}
    for hit in hits:
        if not hit.startswith("+negated"):
            arcs[1][hit] = (f"+reported {hit.removeprefix('+').removeprefix('targeted ')}", 0.0, 1)
    return Transducer(arcs, 0)


def _kind(out: str) -> int:
    """Number in KINDS. A suspicion is one however it is marked; insults that are only targeted are insults, weak threats that are
    marked are threats so marked, insults that are denied or reported count as one that is."""
    if not out.startswith("+"):
        return 0
    name = out.removeprefix("+")
    for whole, plain in (("suspicion", "suspicion"), ("targeted insults", "insults")):
        if name.endswith(whole):
            return KINDS.index(plain)
    return KINDS.index(name if name in KINDS else name.replace("weak threat", "threat").replace("insults", "insult"))


def _scorer(weights: np.ndarray) -> Transducer:
    symbols = ["o", *[f"+{m}{h}" for m in _MARKS for h in _HITS]]
    return Transducer({0: {s: (str(_kind(s)), float(weights[_kind(s)]) if _kind(s) else 0.0, 0) for s in symbols}}, 0)


def grammar(weights: np.ndarray = PRIOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The composed transducer as tables [state, class]: next state, kind, weight. State 0 is the start."""
    whole = _insults().then(_threats()).then(_targets()).then(_negations()).then(_reports()).then(_scorer(weights))
    number = {s: i for i, s in enumerate([whole.start, *[s for s in whole.arcs if s != whole.start]])}
    after, kind, weight = (np.zeros((len(number), len(_CLASSES)), t) for t in (np.int32, np.int8, np.float64))
    for state, arcs in whole.arcs.items():
        for c, name in enumerate(_CLASSES):
            out, w, to = arcs[name]
            after[number[state], c], kind[number[state], c], weight[number[state], c] = number[to], int(out), w
    return after, kind, weight


@dataclass(frozen=True)
class Lexicon:
    """Words (ending in a blank) and stems, by class. A word has the class of its longest entry."""

    entries: dict[str, int]
    lengths: list[tuple[int, bool, np.ndarray, np.ndarray]] = field(init=False, repr=False)
    heads: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        by: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        heads = np.zeros(1 << 16, bool)
        for entry, c in self.entries.items():
            raw = np.frombuffer(entry.rstrip(" ").encode(), np.uint8)
            key = common.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]
            by.setdefault((len(raw), entry.endswith(" ")), []).append((int(key), c))
            heads[int(raw[0]) << 8 | (int(raw[1]) if len(raw) > 1 else 0)] = True
        tables = []
        for (size, exact), found in sorted(by.items()):
            found.sort()
            tables.append((size, exact, np.array([k for k, _ in found], np.uint64), np.array([c for _, c in found], np.int8)))
        object.__setattr__(self, "lengths", tables)
        object.__setattr__(self, "heads", heads)

    def classes(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int8)
        if not len(starts):
            return out
        size = ends - starts
        second = np.where(size > 1, low[np.minimum(starts + 1, len(low) - 1)], 0)
        some = np.flatnonzero(self.heads[low[starts].astype(np.int32) << 8 | second])
        for length, exact, keys, classes in self.lengths:
            fit = some[size[some] == length] if exact else some[size[some] >= length]
            if not len(fit):
                continue
            at = np.minimum(np.searchsorted(keys, found := common.word_hashes(low, starts[fit], starts[fit] + length)), len(keys) - 1)
            hit = keys[at] == found
            out[fit[hit]] = classes[at[hit]]
        return out


def base_lexicon(stems: dict[str, int] | None = None) -> Lexicon:
    entries = {w: INSULT for w in INSULTS}
    for words, c in ((HARM, HARMFUL), (MODALS, MODAL), (TARGETS, TARGET), (NEGATIONS, NEGATION), (SPEECH, SPEAKS)):
        entries |= {f"{w} ": c for w in words}
    return Lexicon(entries | (stems or {}))


def _low_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = common.LOWER[body]
    return low, *common.words(low, offsets, _WORD)


def clause_counts(body: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """texts x kinds: clauses whose heaviest match is of each kind."""
    low, starts, ends, first = _low_words(body, offsets)
    out = np.zeros((len(offsets) - 1, len(KINDS)), np.int32)
    found = lexicon.classes(low, starts, ends)
    hits = np.flatnonzero((found == INSULT) | (found == HARMFUL) | (found == SUSPECT))
    if not len(hits):
        return out
    text = np.searchsorted(first, np.arange(len(starts)), side="right") - 1
    clause = np.cumsum(_BREAK[body])[starts] + text  # grows at every break and every text
    begin = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1]]))
    stop = np.append(begin[1:], len(starts))
    after, kind, weight = tables
    for k in np.unique(np.searchsorted(begin, hits, side="right") - 1).tolist():
        state, best, most = 0, 0, -np.inf
        for c in found[begin[k] : stop[k]].tolist():
            if kind[state, c] and weight[state, c] > most:
                best, most = kind[state, c], weight[state, c]
            state = after[state, c]
        out[text[begin[k]], best] += 1
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    lexicon: Lexicon

    def score(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        tables, out = grammar(self.weights), []
        for i, j in common.slices(offsets, 1 << 20):
            counts = clause_counts(body[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], self.lexicon, tables)
            out.append(_odds(counts) @ self.weights)
        return 1 / (1 + np.exp(-np.concatenate(out))) if out else np.zeros(0)


def _odds(counts: np.ndarray) -> np.ndarray:
    """Factors of the weights: 1 for the bias, then the number of clauses of each kind, up to MOST."""
    x = np.minimum(counts, MOST).astype(np.float64)
    x[:, 0] = 1
    return x


def _units(texts: list[str], shortest: int, longest: int, wanted: set[str] | None = None) -> Counter:
    """In how many texts each beginning of a word stands; whole words have a blank after them."""
    total: Counter = Counter()
    for text in texts:
        low, starts, ends, _ = _low_words(*common.buffers(pa.array([text], pa.string())))
        raw = low.tobytes()
        own = set()
        for word in {raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}:
            w = word.decode("utf-8", "ignore").strip("'")
            own.add(w + " ")
            own.update(w[:k] for k in range(shortest, min(len(w), longest) + 1))
        total.update(own if wanted is None else own & wanted)
    return total


def without_copies(texts: list[str], least: int = 7, smallest: int = 4) -> list[str]:
    """Texts less near copies of an earlier one: those that share two of the ``smallest`` hashes of their words of ``least`` bytes."""
    seen: dict[int, set[int]] = {}
    kept = []
    for n, text in enumerate(texts):
        low, starts, ends, _ = _low_words(*common.buffers(pa.array([text], pa.string())))
        long = ends - starts >= least
        own = np.unique(common.word_hashes(low, starts[long], ends[long]))[:smallest].tolist()
        if max(Counter(i for h in own for i in seen.get(h, ())).values(), default=0) < 2:
            kept.append(text)
            for h in own:
                seen.setdefault(h, set()).add(n)
    return kept


def learned_stems(toxic: list[str], clean: list[str], least: int = 5, share: float = 0.01, rarer: float = 50.0, doubt: float = 5.0, doubt_share: float = 0.04, evidence: float = 25.0, shortest: int = 3, longest: int = 12) -> tuple[list[str], list[str]]:
    """(insults, suspects): stems, and whole words with a blank, of ``least`` toxic texts and a ``share`` of them, beyond chance.

    Insults are ``rarer`` times rarer in clean texts, suspects ``doubt`` times, and stand in a ``doubt_share`` of the toxic ones. A stem
    is as long as it can be without losing a toxic text; longer stems that begin with a taken one add nothing. Suspects are taken
    in the order of what they tell apart: their share of toxic texts less ``doubt`` times that of clean ones.
    """
    if not toxic:
        return [], []
    of_toxic = _units(toxic, shortest, longest)
    some = {u for u, n in of_toxic.items() if n >= max(least, share * len(toxic)) and len(u) > 2}
    of_clean = _units(clean, shortest, longest, some)
    # Twice the log likelihood ratio of "as frequent in toxic texts as seen" to "equally frequent": many beginnings are looked at.
    even = len(toxic) / (len(toxic) + len(clean))
    told = lambda n, m: 2 * (n * np.log(n / (even * (n + m))) + (m * np.log(m / ((1 - even) * (n + m))) if m else 0.0)) if clean else np.inf
    some = {u for u in some if told(of_toxic[u], of_clean[u]) >= evidence}
    p = {u: of_toxic[u] / len(toxic) for u in some}
    q = {u: of_clean[u] / max(1, len(clean)) for u in some}
    taken: list[str] = []

    def covered(u: str) -> bool:
        return any(u.startswith(t) for t in taken)

    good = {u for u in some if q[u] * rarer <= p[u]}
    for u in sorted((u for u in good if not u.endswith(" ")), key=len):
        if covered(u) or any(t.startswith(u) for t in taken):
            continue
        while longer := [v for v in good if v.startswith(u) and len(v) == len(u) + 1 and not v.endswith(" ") and of_toxic[v] == of_toxic[u]]:
            u = longer[0]
        taken.append(u)
    taken += sorted(u for u in good if u.endswith(" ") and not covered(u))
    n = len(taken)
    tells = {u: p[u] - doubt * q[u] for u in some if p[u] >= doubt_share and q[u] * doubt < p[u]}
    for u in sorted(tells, key=lambda u: (-tells[u], -len(u), u)):
        begins = [t for t in taken if t.startswith(u.rstrip(" "))]  # an insult that has most of a suspect's texts makes it idle
        if not covered(u) and not any(t in taken[n:] or 2 * of_toxic[t] >= of_toxic[u] for t in begins):
            taken.append(u)
    return taken[:n], taken[n:]


def fit(texts: list[str], labels: list[int], strength: float = 0.05, rounds: int = 50, **options) -> ToxicityModel:
    """Learns stems, then weights by Newton steps; ``strength`` holds each weight to its fixed value."""
    if len(set(labels)) < 2:
        return ToxicityModel(PRIOR, base_lexicon())
    toxic, clean = ([t for t, y in zip(texts, labels, strict=True) if y == k] for k in (1, 0))
    # A word that only a group of copies has would else look like one of many texts.
    insults, suspects = learned_stems(without_copies(toxic), without_copies(clean), **options)
    lexicon = base_lexicon({s: SUSPECT for s in suspects} | {s: INSULT for s in insults})
    counts = np.concatenate([clause_counts(b[o[i] : o[j]], o[i : j + 1] - o[i], lexicon, grammar()) for b, o in [common.buffers(pa.array(texts, pa.string()))] for i, j in common.slices(o, 1 << 20)])
    x, y, w = _odds(counts), np.array(labels, np.float64), PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + strength * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return ToxicityModel(w, lexicon)


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1500, clean: int = 3000, sample_bytes: int = 48 << 20, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", **options) -> ToxicityModel:
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    rank = F.xxhash64(F.col("id"), F.lit(29))
    picks = [known.filter(F.col("y") == y).select("id", "y", rank.alias("h")).orderBy("h", "id").limit(most) for y, most in ((0, clean), (1, toxic))]
    chosen = [tuple(r) for r in picks[0].unionByName(picks[1]).collect()]  # ``clean + toxic`` rows at most
    if not chosen:
        return fit([], [], **options)
    keys = docs.sparkSession.createDataFrame(chosen, "id long, y int, h long")
    met = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(keys), "id")
    # One text of each id, the smallest by hash; all of the sample's texts stay in the shared folder until their bytes are known.
    held = common.written(met.groupBy("id", "y", "h").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t")), "sample")
    sizes = sorted((r["h"], r["id"], r["n"]) for r in held.select("id", "h", F.octet_length("t").alias("n")).collect())
    fits, room = [], sample_bytes
    for _, i, n in sizes:
        if n <= room:
            fits.append((i,))
            room -= n
    wanted = docs.sparkSession.createDataFrame(fits, "id long")
    got = held.join(F.broadcast(wanted), "id", "left_semi").orderBy("h", "id").collect()
    common.drop_table(held)
    model = fit([r["t"] for r in got], [r["y"] for r in got], **options)
    common.release(True)
    return model


def assess(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a last column ``into``: the probability of being toxic.

    Where ``docs`` has a column of that name, underscores are added to it; the new column is the last one in any case.
    """
    into = common.free_name(docs, into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.release()
        for batch in batches:
            found = pa.array(shared.value.score(*common.buffers(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], schema=pa.schema([*batch.schema, pa.field(into, found.type)]))

    return docs.mapInArrow(score, schema)
