import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import rangecoder, tokenfiles, tokens
from topicloom.llm.packing import pack, plan
from topicloom.llm.sampling import Lattice, sampled

BYTES, WORDS, PIECES = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json"), tokens.vocabulary("piece_bpe_32k.model")
ENCODERS = {s: tokens.UnitEncoder(v) for s, v in (("bytes", BYTES), ("words", WORDS))}
ODD = ["", None, " ", "a  b", " a", "a ", "a\n b", "x <|endoftext|> y", "don't  stop\t now.", "é́ ẞ İ", "日本 語 テスト", "a  b", "\n\n a", "it's 'll, a.", "Σας ΣΑΣ σ.", "×, ÷. ß. é, »,", "1, 2.", ".", "a.\nB\n\nC\n d", "x  y　 z   w", "a\x1c b", "Привет, мир.", "a\r\nb\n", "é\nÉ", "nul\0 byte. x", "İ Á, x"]


@pytest.mark.parametrize("split", ["bytes", "words"])
def test_units_give_the_library_ids(split):
    own = ENCODERS[split]
    assert own.batch(tokens.SPLITS[split](pa.array(ODD, pa.string()))) == own.whole([t or "" for t in ODD])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,\n\t  1'ß日\x1c!　", max_size=25), max_size=6))
def test_units_give_the_library_ids_for_any_text(texts):
    for split, own in ENCODERS.items():
        assert own.batch(tokens.SPLITS[split](pa.array(texts, pa.string()))) == own.whole(texts)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**16 - 1) | st.integers(0, 3), min_size=1, max_size=400), st.sampled_from([7, 64, 1024]))
def test_range_coder_round_trip(ids, block):
    words, sizes = rangecoder.encode(np.array(ids), block, 16)
    assert rangecoder.decode(words, sizes, len(ids), block, 16).tolist() == ids


def test_range_coder_learns_and_blocks_stand_alone():
    ids = np.tile(np.arange(50), 400)
    words, sizes = rangecoder.encode(ids, 1000, 17)
    assert 32 * len(words) < 4 * len(ids)
    at = np.cumsum(sizes)
    assert rangecoder.decode(words[at[2] : at[3]], sizes[3:4], 1000, 1000, 17).tolist() == ids[3000:4000].tolist()
    with pytest.raises(ValueError, match="bits"):
        rangecoder.encode(ids, 10, 30)


def test_token_files(spark, texts, tmp_path):
    path = str(tmp_path / "ids")
    tokenfiles.write_token_files(texts, path, BYTES, files=3, segment_ids=500, block=64)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in texts.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {t: ENCODERS["bytes"].whole([t])[0] + b"\0" * 4 for _, t in rows}
    got = sorted(tokenfiles.read_token_files(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [str(r["doc_id"]) for r in got] == [str(i) for i, _ in rows]
    start = 0
    for r, (_, t) in zip(got, rows, strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids[t]) // 4, zlib.crc32(ids[t]), ids[t])
        start += r["n_tokens"]


def test_damaged_segment():
    data = bytearray(tokenfiles.pack_segment(np.array([1]), np.array([300]), np.arange(300), 64, 16))
    keys, sizes, ids = tokenfiles.unpack_segment(bytes(data))
    assert (keys.tolist(), sizes.tolist(), ids.tolist()) == ([1], [300], list(range(300)))
    data[-40] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        tokenfiles.unpack_segment(bytes(data))


def test_no_documents(spark, nothing, tmp_path):
    tokenfiles.write_token_files(nothing, str(tmp_path / "none"), BYTES, files=2)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "none")).count() == 0
    assert pack(nothing, WORDS).count() == 0
    assert sampled(nothing, PIECES).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_every_item_once(counts):
    placed: dict[int, list] = {}
    seen = dict.fromkeys(counts, 0)
    runs = plan(counts, 64)
    for n, first, bins, first_bin, offset in runs:
        assert first == seen[n]
        following = min([f for m, f, *_ in runs if m == n and f > first], default=counts[n])  # where the next run of its length begins
        ranks = following - first
        for r in range(ranks):
            placed.setdefault(first_bin + r % bins, []).append((offset + r // bins * n, n))
        seen[n] += ranks
    assert seen == counts
    for items in placed.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64


def test_plan_is_tight():
    draw = np.random.default_rng(2)
    values, n = np.unique(np.minimum(2048, draw.lognormal(6, 1, 20_000).astype(int) + 1), return_counts=True)
    counts = dict(zip(values.tolist(), n.tolist(), strict=True))
    bins = max(b + k for _, _, k, b, _ in plan(counts, 2048))
    total = sum(k * v for k, v in counts.items())
    assert bins <= 1.002 * total / 2048 + 2


def test_two_fit_replaces_the_smallest():
    # Greedy gives 6 + 3 (gap 1); 2 + 2 fills the room of 3 and the gap.
    runs = plan({6: 1, 3: 1, 2: 2}, 10)
    assert {n for n, _, _, b, _ in runs if b == 0} == {6, 2}


def test_packing_covers_all_ids(spark, texts):
    rows = {(r["doc_id"], r["text"]) for r in texts.collect()}
    total = sum(len(ENCODERS["words"].whole([r["text"] or ""])[0]) // 4 + 1 for r in texts.collect())
    got = pack(texts, WORDS, 512).collect()
    assert sum(r["length"] for r in got) == total and len(rows) > 5
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        ends = [a + n for a, n in sorted(items)]
        assert [a for a, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 512


def test_sampling_is_lossless_and_repeatable(spark, texts):
    one = sampled(texts, PIECES)
    assert one.filter("not lossless").count() == 0
    again = sampled(texts.repartition(7), PIECES)
    key = lambda df: sorted((str(r["doc_id"]), r["ids_crc32"], r["n_pieces"]) for r in df.collect())
    assert key(one) == key(again)
    assert key(sampled(texts, PIECES, seed=1)) != key(one)


def paths(lattice, word):
    if not word:
        return {(): 1.0}
    out, node = {}, lattice.trie
    for j, c in enumerate(word):
        node = node.get(c)
        if node is None:
            break
        if "" in node:
            for rest, p in paths(lattice, word[j + 1 :]).items():
                out[(node[""][0], *rest)] = node[""][1] * p
    return out


def test_sampling_follows_the_lattice():
    own = Lattice(PIECES, alpha=0.5)
    all_ = paths(own, "there")
    total = sum(all_.values())
    ids, per = own.sample(["there"] * 20_000, np.arange(20_000))
    ends = np.cumsum(per)
    seen: dict = {}
    for e, n in zip(ends.tolist(), per.tolist(), strict=True):
        p = tuple(ids[e - n : e].tolist())
        seen[p] = seen.get(p, 0) + 1 / 20_000
    for p, w in sorted(all_.items(), key=lambda x: -x[1])[:8]:
        assert seen.get(p, 0) == pytest.approx(w / total, abs=0.012)


def test_long_words_are_filtered_alike():
    one, two = Lattice(PIECES), Lattice(PIECES)
    two.LONG = 0
    texts = ["some words thereof", "x" * 300, "日" * 100 + " é", "a▁b \n"]
    a, b = one.sample(texts, np.arange(4)), two.sample(texts, np.arange(4))
    assert a[1].tolist() == b[1].tolist() and a[0].tolist() == b[0].tolist()
    ends = np.cumsum(a[1])
    for t, e, n in zip(texts, ends, a[1], strict=True):
        assert one.decode(a[0][e - n : e].tolist()) == t.encode()


def test_coder_beats_static_frequencies():
    """On the ids of a whole table: fewer bits an id than the entropy of the table's own id frequencies."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].combine_chunks()
    raw = b"".join(x + b"\0" * 4 for x in ENCODERS["bytes"].batch(tokens.SPLITS["bytes"](texts)))
    ids = np.frombuffer(raw, "<u4").astype(np.int64)
    words, sizes = rangecoder.encode(ids, 1 << 18, 16)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 32 * len(words) / len(ids) < 0.96 * -(share * np.log2(share)).sum()
    assert np.array_equal(rangecoder.decode(words, sizes, len(ids), 1 << 18, 16), ids)


@pytest.mark.parametrize("n", [1, 511, 1023, 1024, 5000, 70_000])
@pytest.mark.parametrize("id_bits", [9, 16, 17])
def test_coder_lanes_and_wide_ids(n, id_bits):
    draw = np.random.default_rng(n)
    ids = np.minimum(draw.integers(0, 1 << id_bits, n), draw.integers(0, 1 << id_bits, n))
    words, sizes = rangecoder.encode(ids, 2048, id_bits)
    assert len(sizes) == -(-n // 2048)
    assert np.array_equal(rangecoder.decode(words, sizes, n, 2048, id_bits), ids)


def test_coder_refuses_blocks_it_has_no_precision_for():
    with pytest.raises(ValueError, match="block"):
        rangecoder.encode(np.arange(4), rangecoder.MOST_BLOCK + 1, 16)


@pytest.mark.parametrize("most", [0, 7, 60])
def test_full_memory_changes_no_ids(most):
    """Units beyond the memory's bound, long ones and returning ones: always the library's ids."""
    draw = np.random.default_rng(most)
    own = tokens.UnitEncoder(BYTES, most=most, longest=20)
    for _ in range(6):
        texts = [" ".join("".join(draw.choice(list("abé,.% \n"), draw.integers(1, 30))) for _ in range(20)) for _ in range(3)]
        assert own.batch(tokens.SPLITS["bytes"](pa.array(texts))) == own.whole(texts)
        assert own.memory.n <= most and len(own.memory.long) <= most


def test_text_without_blanks_is_cut_where_no_piece_reaches(spark):
    """Long words: parts that no piece spans, each path's chance unchanged, whole texts lossless."""
    own = Lattice(PIECES)
    pieces = {own.bytes_of[i].decode() for i in range(own.size) if len(own.bytes_of[i]) > 1 and not own.bytes_of[i].startswith(b" ")}
    for word in ("日本語テスト" * 40, "there" * 30, "aé日" * 50, "x" * 200):
        parts = own._apart(word)
        assert "".join(parts) == word
        at = 0
        for part in parts[:-1]:
            at += len(part)
            around = [(a, b) for a in range(max(0, at - 20), at) for b in range(at + 1, min(len(word), at + 20) + 1)]
            assert not any(word[a:b] in pieces for a, b in around)
    word = "there" + "日" * 38
    one = own.sample([word] * 4000, np.arange(4000))
    two = own.sample(["there"] * 4000, np.arange(4000))
    ends = np.cumsum(one[1])
    heads: dict = {}
    for e, n in zip(ends.tolist(), one[1].tolist(), strict=True):
        raw, k = b"", 0
        while raw != b"there":
            raw += own.bytes_of[one[0][e - n + k]]
            k += 1
        heads[k] = heads.get(k, 0) + 1 / 4000
    plain = np.bincount(two[1]) / 4000
    assert all(heads.get(k, 0) == pytest.approx(p, abs=0.04) for k, p in enumerate(plain))
    long = spark.createDataFrame([(1, "日本語の文章を切らずに書く" * 8000), (None, "no key"), (None, "no key")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in sampled(long, PIECES).collect()}
    assert all(r["lossless"] for r in got.values()) and len({r["ids_crc32"] for r in sampled(long, PIECES).filter("doc_id is null").collect()}) == 1


def test_null_key_is_the_hash_zero(spark):
    df = spark.createDataFrame([(None, "some words thereof")], "doc_id long, text string")
    ids, _ = Lattice(PIECES).sample(["some words thereof"], np.zeros(1, np.int64))
    assert sampled(df, PIECES).first()["ids"] == ids.astype("<u4").tobytes()
