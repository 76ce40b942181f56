"""Each registered query opN_ that SQL can't express, as registered, on a whole small table against a brute-force version."""

import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from topicloom.llm import common, language, licenses, quality, sampling, tokens
from topicloom.llm.queries import QUERIES

TYPES = {
    "op1_quality_classifier": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op2_embedding_near_dedup": [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op4_best_fit_packing": [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")],
    "op6_license_scan": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")],
    "op7_minhash_near_dedup": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op8_token_files": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op9_exact_dedup": [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")],
    "op10_language_id": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
}


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_types(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).dtypes[: len(TYPES[name])] == TYPES[name]


def ids_of(path, text):
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def passages(text):
    """Features of each passage of a text, counted one by one."""
    raw = (text or "").encode()
    words = [(m.start(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    cuts = [0, *(words[i][0] for i in range(64, len(words), 64)), len(raw)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        own, part = [w for _, w in words[64 * k : 64 * k + 64]], raw[a:b]
        n = max(1, len(own))
        shares = [0.0] * 136
        for byte in part:
            shares[byte if byte < 128 else 128 + (byte - 128) // 16] += 1 / len(part)
        mean = sum(map(len, own)) / n
        spread = math.sqrt(max(0.0, sum(len(w) ** 2 for w in own) / n - mean**2))
        yield np.array([*shares, mean / 8, spread / 8, len(set(own)) / n, sum(65 <= w[0] <= 90 for w in own) / n, len(own) / 64, math.log1p(len(part)) / 8])


def test_op1(spark, sf_dir, docs):
    fold = common.id_crc32("doc_id") % 5
    model = quality.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels").filter(fold != 0))
    w = model.layers
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_classifier"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        hidden, attention = [], []
        for x in passages(text):
            h = np.tanh((x - model.mean) / model.spread @ w["enc"] + w["enc0"])
            hidden.append(h)
            attention.append(math.exp(float((np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))) @ w["a"])))
        z = sum(a * h for a, h in zip(attention, hidden, strict=True)) / sum(attention)
        p = 1 / (1 + math.exp(-float(z @ w["out"] + w["out0"][0])))
        r = got[doc_id]
        assert r["score"] == pytest.approx(p, abs=1e-4)
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)


def test_op4(spark, sf_dir, docs):
    got, path = defaultdict(list), tokens.vocabulary("word_bpe_49k.json")
    bins, total = defaultdict(list), 0
    for r in QUERIES["op4_best_fit_packing"](spark, sf_dir).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = ids_of(path, text)
        total += len(ids)
        want = [(k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
        assert sorted(got.pop(doc_id)) == want
    assert not got
    for items in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(items)]).tolist()
        assert [a for a, _ in sorted(items)] == ends[:-1] and ends[-1] <= 2048
    assert len(bins) <= 1.02 * total / 2048 + 1


def test_op5(spark, sf_dir, docs):
    import sentencepiece

    path = tokens.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = common.table(spark, sf_dir, "documents")
    drawn = {r["doc_id"]: r["ids"] for r in sampling.sampled(table, path).collect()}
    for r in QUERIES["op5_piece_sampling"](spark, sf_dir).collect():
        ids = np.frombuffer(drawn[r["doc_id"]], "<u4").tolist()
        raw = b"".join(bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids)
        assert raw.decode() == (dict(docs)[r["doc_id"]] or "")
        assert (r["n_pieces"], r["ids_crc32"], r["lossless"]) == (len(ids), zlib.crc32(drawn[r["doc_id"]]), True)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]


def test_op6(spark, sf_dir, docs):
    """Base columns by search. The method's labels: there where a whole notice stands, absent where no gram of one does."""
    notices = [(label, words_of(text)) for label, text in licenses.TEMPLATES]
    got = {r["doc_id"]: r for r in QUERIES["op6_license_scan"](spark, sf_dir).collect()}
    decided = 0
    for doc_id, text in docs:
        words, r = words_of(text), got.pop(doc_id)
        base = [(at, label) for phrase, label in licenses.PHRASES.items() for at in places(words, phrase.split())]
        at = [a for a, _ in base]
        labels = sorted({label for _, label in base})
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        own = set(r["labels"].split(",")) - {""}
        assert own >= set(labels) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(own)
        grams = {tuple(words[i : i + n]) for n in (3, licenses.K) for i in range(len(words) - n + 1)}
        for label in {label for label, _ in notices}:
            mine = [w for x, w in notices if x == label]
            if any(places(words, w) for w in mine):
                assert label in own
                decided += 1
            elif label not in labels and not any(tuple(w[i : i + licenses.K]) in grams for w in mine for i in range(len(w) - min(licenses.K, len(w)) + 1)):
                assert label not in own
    assert not got and decided > 0


def test_op7(spark, sf_dir, docs):
    from .test_minhash import brute

    sizes, component = brute(docs)
    want = sorted((i, n, c, i == c) for (i, _), n, c in zip(docs, sizes, component, strict=True))
    assert sorted(tuple(r)[:4] for r in QUERIES["op7_minhash_near_dedup"](spark, sf_dir).collect()) == want


def test_op8(spark, sf_dir, docs):
    path, start, want = tokens.vocabulary("byte_bpe_50k.json"), 0, []
    for doc_id, text in sorted(docs):
        ids = ids_of(path, text)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r)[:4] for r in QUERIES["op8_token_files"](spark, sf_dir).collect()) == want


def test_op10(spark, sf_dir, docs):
    fold = common.id_crc32("doc_id") % 4
    model = language.train(common.table(spark, sf_dir, "documents"), fold != 2)
    got = {r["doc_id"]: r for r in QUERIES["op10_language_id"](spark, sf_dir).collect()}
    for doc_id, text in docs:
        raw, r = (text or "").encode(), got[doc_id]
        low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        codes = set()
        for n in (1, 2, 3):
            codes |= {int(language.gram_codes(np.frombuffer(low[i : i + n], np.uint8))[n - 1][0]) for i in range(len(low) - n + 1)}
        z = [model.scale * sum(model.weights[c, k] for c in codes) / math.sqrt(max(1, len(codes))) for k in range(len(model.classes))]
        p = [math.exp(v - max(z)) / sum(math.exp(u - max(z)) for u in z) for v in z]
        fine = any(c.isalpha() for c in text or "")
        assert r["lang_pred"] == (model.classes[p.index(max(p))] if fine else "und")
        assert r["score"] == pytest.approx(max(p) if fine else 0.0, abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_op10_scores_are_the_kernel_expansion():
    """The folded weights give what the Nyström regression gives when each kernel value is counted for itself."""
    import pyarrow as pa

    draw = np.random.default_rng(4)
    texts = ["".join(draw.choice(list("abcde é"), draw.integers(1, 60))) for _ in range(40)]
    labels = [str(i % 3) for i in range(40)]
    model = language.fit(texts, labels, landmarks=15, ridge=0.01, scale=2.0)
    sets = [set(s.tolist()) for s in language.presence(*common.buffers(pa.array(texts)))]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks = [sets[i] for i in np.unique(np.linspace(0, 39, 15).astype(int))]
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    some = values > 1e-6 * values.max()
    whiten = vectors[:, some] / np.sqrt(values[some])
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ whiten
    y = np.array([[1.0 if x == c else -1.0 for c in "012"] for x in labels])
    weight = np.array([40 / 3 / labels.count(x) for x in labels])
    w = np.linalg.solve((phi * weight[:, None]).T @ phi + 0.01 * 40 * np.eye(phi.shape[1]), (phi * weight[:, None]).T @ y)
    z = 2.0 * (phi @ w)
    want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert model.scores(*common.buffers(pa.array(texts))) == pytest.approx(want, abs=1e-9)


def test_op10_ties_go_to_the_first_language():
    import pyarrow as pa

    model = language.LanguageModel(("aa", "bb"), np.zeros((1 << 16, 2)), 1.0)
    assert model.scores(*common.buffers(pa.array(["same"]))).tolist() == [[0.5, 0.5]]
