"""Cases in which an operator or a stage once did less than the whole job."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from telemetra.llm import bpe, near, suffixes, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def table(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(1, len(texts) + 1), texts, strict=True)], COLUMNS)


@pytest.mark.parametrize("group", [suffixes.GROUP, 1])
def test_passages_of_51_words_are_cut_whatever_their_bytes(spark, group):
    rng = random.Random(3)
    passage, short, one = prose(rng, 51), prose(rng, 50), " ".join("abcdefghijklmnopqrstuvwxyz" * 2)[:101]
    spaced = passage.replace(" ", "\n")
    assert len(passage) < 400 and len(one.split()) == 51
    texts = [prose(rng, 30) + " " + passage + " " + prose(rng, 20), passage + " x", prose(rng, 70) + " " + spaced, prose(rng, 9) + " " + short, short + " y", one + " z", "w " + one, None, ""]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, words=51, group=group).collect()}
    want = [(t or "").replace(passage, "").replace(spaced, "").replace(one, "") for t in texts]
    assert [got[k].kept_text for k in sorted(got)] == want
    if group > 1:
        cut = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["repeated passages"](spark, docs, "").collect()}
        assert [cut[k] or "" for k in sorted(cut)] == want


def test_runs_of_words_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [prose(rng, k) for k in (40, 51, 60, 75, 130)]
    texts = [" ".join(rng.choice([prose(rng, rng.randint(1, 40)), rng.choice(pool)]) for _ in range(4)) for _ in range(30)]
    texts += ["la " * 120, "la " * 55, "la " * 40]
    words, seen = [t.split() for t in texts], {}
    for w in words:
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])] = seen.get(tuple(w[i : i + 51]), 0) + 1
    got = {r.doc_id: r.kept_text for r in suffixes.remove_repeats(table(spark, texts), n=100_000, words=51).collect()}
    for k, w in enumerate(words, 1):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 50):
            if seen[tuple(w[i : i + 51])] > 1:
                gone[i : i + 51] = True
        assert got[k].split() == [x for x, g in zip(w, gone, strict=True) if not g]


def thue_morse(bits, one, other):
    return "".join(one if bin(k).count("1") % 2 else other for k in range(1 << bits))


def test_words_that_sums_of_powers_confuse_stay_apart(spark):
    """Thue-Morse words of 1,024 to 4,096 characters and their complements: equal under any polynomial modulo 2**64."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    for bits in (10, 11, 12):
        a, b = thue_morse(bits, "x", "y"), thue_morse(bits, "y", "x")
        assert words.word_hashes(a.encode())[0] != words.word_hashes(b.encode())[0]
        ids, sizes = codec.encode_batch([f"{a} {b}", b])
        for text, own in zip([f"{a} {b}", b], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == library.encode(text, add_special_tokens=False).ids
    got = near.near_duplicates(table(spark, [f"{a} one", f"{b} one", f"{a}  ONE"])).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [1, 2, 1]


def test_chunks_with_one_fingerprint_are_told_apart(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    monkeypatch.setattr(bpe, "fingerprints", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["the same length", "a longer text than that", "", "x y z", "the same length"]
    ids, sizes = codec.encode_batch(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert own.tolist() == library.encode(text, add_special_tokens=False).ids


def test_short_words_have_fingerprints_of_their_own():
    data = np.frombuffer(b"".join(k.to_bytes(3, "little") for k in range(200_000)), np.uint8)
    at = np.arange(0, len(data), 3)
    assert len(np.unique(words.fingerprints(data, at, at + 3))) == 200_000


def test_corpus_order_of_a_dictionary():
    """Suffix ranks follow the sorted suffixes; equal suffixes share a rank."""
    strings = [b"banana", b"ana", b"", b"nana" * 60]
    begin, rank = suffixes.suffix_ranks(strings)
    own = [(s[i:], rank[b + i]) for s, b in zip(strings, begin, strict=True) for i in range(len(s))]
    for x, r in own:
        for y, q in own:
            assert (x < y) == (r < q) and (x == y) == (r == q)


def test_no_pair_at_the_threshold_is_left_out_by_its_signature(spark):
    """Sets of 5 and 4 shingles, similarity 0.8, whose low bits agree nowhere but in equal minima."""
    firsts = [14418, 47964, 57942, 99146, 104665]
    texts = [" ".join(f"w{i + k}" for k in range(n)) for i in firsts for n in (6, 5)]
    got = near.near_duplicates(table(spark, texts), width=2).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == [(n, 2 * k + 1) for k in range(len(firsts)) for n in (5, 4)]


def test_the_least_agreement_is_a_tail_of_the_binomial():
    rng = np.random.default_rng(5)
    assert 0 < near.agreeing(near.SIGNED, 0.8) <= rng.binomial(near.SIGNED, 0.8, 1_000_000).min()
    assert near.agreeing(near.SIGNED, 1.0) == near.SIGNED
    assert (1 - 0.8**near.ROWS) ** near.BANDS < 1e-11
