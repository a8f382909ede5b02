"""Models and pipeline stages against plain versions that share no code with them but the fitted numbers."""

import bisect
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from telemetra.llm import quality, toxicity, words
from telemetra.llm.queries import VOCABULARY

D = "/root/testdata/sf0.001"
SPACE = "\t\n\x0b\x0c\r "


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            out, word = (out + [word] if word else out), ""
        else:
            word += c
    return out + [word] if word else out


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_network(net, text):
    """One text through the network, filter by filter and place by place."""
    own = [toxicity.slots(words.word_hashes(w.encode()))[0] for w in plain_words(text)]
    rows = [[*net.table[int(a)], *net.table[toxicity.SLOTS + int(b)]] for a, b in own]
    total, at = float(net.last[0]), 0
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = None
            for i in range(len(rows) - width + 1):
                x = sum(rows[i + j][d] * net.filters[width][j, d, f] for j in range(width) for d in range(2 * toxicity.DIM))
                best = x if best is None else max(best, x)
            hidden = max(0.0, (best or 0.0) + float(net.bias[at]))
            total += hidden * float(net.dense[at])
            at += 1
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def plain_additive(model, x):
    """Bin by bin, table by table."""
    b = [bisect.bisect_right(list(e), v) for e, v in zip(model.edges, x, strict=True)]
    total = model.intercept + sum(model.tables[k][i] for k, i in enumerate(b))
    for k, (i, j) in enumerate(model.pairs):
        total += model.pair_tables[k][b[i] * quality.COARSE // quality.BINS][b[j] * quality.COARSE // quality.BINS]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = (spark.read.parquet(f"{D}/{n}.parquet") for n in ("documents", "labels"))
    return toxicity.train(docs, labels), quality.train(docs, labels)


TEXTS = ["", " \n", "one", "One two", "a b c d e f g", "x" * 300 + " y", "Zuä été 12 34!?", "the the the " * 30]


def test_network_equals_plain_forward_pass(models):
    got = models[0].score([t.encode() for t in TEXTS])
    assert np.allclose(got, [plain_network(models[0], t) for t in TEXTS], atol=1e-4)


def test_additive_model_equals_plain_sum_of_tables(models):
    x = quality.features([t.encode() for t in TEXTS])
    assert np.allclose(models[1].score(x), [plain_additive(models[1], row) for row in x])
    plain = dict(zip(quality.FEATURES, x[4], strict=True))  # "a b c d e f g"
    assert (round(math.expm1(plain["bytes"])), round(math.expm1(plain["words"])), plain["mean_length"], plain["distinct"], plain["short"]) == (13, 7, 1.0, 1.0, 1.0)


def test_gradient_of_maxima_goes_to_the_first_greatest_place():
    values = np.array([[1.0, 5], [3, 5], [3, 0], [9, 9], [0, 2], [7, 2]], np.float32)
    assert toxicity.first_maxima(values, np.array([0, 4]), np.array([3, 6])).tolist() == [[1, 0], [5, 4]]


def near_kept(rows):
    sets = {}
    for d, t in rows.items():
        w = plain_words(lowered(t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in rows}

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = of(a), of(b)
                root[max(x, y)] = min(x, y)
    return {d for d in ids if of(d) == d}


def without_repeats(rows):
    raw = {d: (t or "").encode() for d, t in rows.items()}
    seen, runs, spans = Counter(), Counter(), {}
    for d, t in raw.items():
        seen.update(t[i : i + 400] for i in range(len(t) - 399))
        spans[d], at = [], 0
        for w in plain_words(rows[d]):
            at = t.index(w.encode(), at)
            spans[d].append((at, at + len(w.encode())))
            at += len(w.encode())
        own = [t[a:b] for a, b in spans[d]]
        runs.update(tuple(own[i : i + 51]) for i in range(len(own) - 50))
    out = {}
    for d, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        own = [t[a:b] for a, b in spans[d]]
        for i in range(len(own) - 50):
            if runs[tuple(own[i : i + 51])] > 1:
                gone[spans[d][i][0] : spans[d][i + 50][1]] = True
        out[d] = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline_equals_plain_stages(spark, models):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    clean = {d: t for d, t in rows.items() if plain_network(models[0], t) < 0.7}
    good = {d: t for d, t in clean.items() if plain_additive(models[1], quality.features([(t or "").encode()])[0]) >= 0.3}
    once = {d: good[d] for d in near_kept(good)}
    left = without_repeats(once)
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for (name, stage), want in zip(P.STAGES, (clean, good, once, left), strict=False):
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
        assert {r.doc_id: r.text or "" for r in docs.collect()} == {d: t or "" for d, t in want.items()}, name
    assert 0 < len(left) < len(rows) and any(left[d] != (once[d] or "") for d in left)
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    ids = {d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for d, t in left.items()}
    packed = P.run(spark, D).toPandas()
    assert {d: int(g.length.sum()) for d, g in packed.groupby("doc_id")} == {d: len(x) for d, x in ids.items()}
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in packed.itertuples())
