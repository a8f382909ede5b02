"""Each operator against a plain version on small tables that hold nulls, empty and long texts, ties, copies and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemetra.llm import bpe, common, counts, lattice, near, packing, quality, suffixes, topk, toxicity, urls, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, key string, score string, id string, place string, part string"


def documents():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = make(300), make(120)
    texts = [None, "", " \t\n", "one", "One", "two words", base, base, base.replace(" ", "  "), make(90) + passage + make(40), passage + make(60), "ab" * 900, "Ab ab " * 400, make(3000), "é漢😀 " * 200]
    for k in range(12):  # near copies, each of the one before
        w = base.split() if not k else texts[-1].split()
        w[rng.randrange(len(w))] = "x%d" % k
        texts.append(" ".join(w))
    texts += [make(rng.randint(1, 200)) for _ in range(40)]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k + 10, t, "en", "k", "s", "i", "p", "q") for k, t in enumerate(documents())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_codec_equals_library():
    c, t = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "\u3000", "a", "the", "é", "à", "漢字", "😀", "²", "1", "!", "'s", "<|endoftext|>", "<|endo", "_", "ſ", "\x00", "\u200b", "ing"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 5000, " " * 3000 + "x", ""]
    ids, sizes = c.encode_batch(texts)
    for text, own, e in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == e.ids == c.encode_whole(text).tolist()
        assert c.decode(own) == t.decode(e.ids, skip_special_tokens=False)


def test_codec_query(docs, none):
    t = Tokenizer.from_file(PATH)
    for r, x in zip(bpe.encode_documents(docs, PATH).orderBy("doc_id").collect(), docs.orderBy("doc_id").collect(), strict=True):
        ids = np.array(t.encode(x.text or "", add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((x.text or "").encode()).hexdigest())
    assert bpe.encode_documents(none, PATH).count() == 0


def test_word_hashes_are_those_of_the_words():
    long = "x" * 200_000
    a, b = words.word_hashes(f"{long} b {long[:-1]}y".encode()), words.word_hashes(f"b {long}".encode())
    assert a[0] == b[1] and a[1] == b[0] and a[2] != a[0]
    assert words.word_hashes(b"AbC")[0] == words.word_hashes(b" aBc\n")[0]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, width):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = []
    for r in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = {r.doc_id: r.doc_id for r in rows}

    def of(x):
        return x if root[x] == x else of(root[x])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = of(rows[i].doc_id), of(rows[j].doc_id)
                root[max(x, y)] = min(x, y)
    got = near.near_duplicates(docs, width).orderBy("doc_id").collect()
    assert got == near.near_duplicates(docs, width, block_bytes=1500, family_blocks=0).orderBy("doc_id").collect()  # bucket by bucket
    assert [(g.doc_id, g.n_shingles, g.component_id, g.kept) for g in got] == [(r.doc_id, len(s), of(r.doc_id), of(r.doc_id) == r.doc_id) for r, s in zip(rows, sets, strict=True)]
    assert near.near_duplicates(none).count() == 0


@pytest.mark.parametrize("group", [4096, 1])
def test_repeats(docs, none, group):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    texts = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffixes.remove_repeats(docs, group=group).orderBy("doc_id").collect()
    assert [(g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got] == want
    assert suffixes.remove_repeats(none).count() == 0


def test_packing(docs, none):
    t = Tokenizer.from_file(PATH)
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    got = packing.pack(docs, PATH).toPandas()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id]) for r in got.itertuples())
    assert got.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(none, PATH).count() == 0
    twice = packing.pack(docs.unionByName(docs).unionByName(docs.withColumn("doc_id", F.lit(None).cast("long"))), PATH, ranges=7).toPandas()
    assert (twice.groupby("doc_id").length.sum() == 2 * got.groupby("doc_id").length.sum()).all()
    s = twice.sort_values(["sequence_id", "offset"])
    assert (s.offset == s.groupby("sequence_id").length.cumsum() - s.length).all() and s.groupby("sequence_id").length.sum().max() <= 1024


def test_packing_has_little_padding_at_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert 1 - got.n.sum() / (1024 * len(got)) < 0.02
    assert packing.range_count(0, 1024, 200) == 1 and packing.range_count(1 << 40, 1024, 200) == 4096


def test_hilbert_steps_to_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_counts_follow_edits(docs, none):
    t = Tokenizer.from_file(PATH)
    edits = [(3, 8, "new  text"), (0, 0, "\u00a0 "), (5, 5, None), (10_000_000, 10_000_001, " end"), (2, 40, ""), (None, 1, "<|endoftext|>")]
    col = F.array(*(F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"), F.lit(c).cast("string").alias("text")) for a, b, c in edits))
    got = {r.doc_id: r for r in counts.count_tokens(docs.withColumn("edits", col), PATH, trees=True).collect()}
    for r in docs.collect():
        text = r.text or ""
        assert got[r.doc_id].n_tokens == len(t.encode(text, add_special_tokens=False).ids)
        for a, b, c in edits:
            a = min(max(a or 0, 0), len(text))
            b = min(max(b, a), len(text))
            text = text[:a] + (c or "") + text[b:]
        assert got[r.doc_id].n_tokens_edited == len(t.encode(text, add_special_tokens=False).ids) == sum(x.tokens for x in got[r.doc_id].leaves)
    assert counts.count_tokens(none, PATH, edits=None).count() == 0
    # leaves that were kept: the same counts, and none of the text but the regions of the edits is encoded
    kept = counts.count_tokens(docs.withColumn("edits", col), PATH, edits=None, trees=True, carry=("text", "edits"))
    kept = kept.withColumn("leaves", F.when(F.col("doc_id") == 16, F.slice("leaves", 1, 2)).when(F.col("doc_id") == 17, None).otherwise(F.col("leaves")))  # stale and missing ones
    for r in counts.count_tokens(kept, PATH, leaves="leaves").collect():
        e = got[r.doc_id]
        assert (r.n_tokens, r.n_tokens_edited, r.n_chars_edited, r.n_chars_encoded) == (e.n_tokens, e.n_tokens_edited, e.n_chars_edited, e.n_chars_encoded)


def test_edits_at_leaf_starts_after_edits_that_shrink():
    c, t = bpe.Codec(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(8)
    for trial in range(200):
        text = " ".join(rng.choice(["the", "ing", "token", "a", "\u00e9t\u00e9", "x\n"]) for _ in range(rng.randint(1, 120)))
        tree = counts.Tree(counts.leaves_of(c, [text])[0])
        for _ in range(6):
            starts = np.append(0, np.cumsum(tree.leaves[:, 0])).tolist()
            a = min(rng.choice(starts), len(text))
            b = min(len(text), a + rng.choice([0, 1, 1, 60, 200]))
            text, tree, _ = counts.edit(c, text, tree, a, b, rng.choice(["", "", "b", " ", "ly"]))
            assert int(tree.sums[1, 1]) == len(t.encode(text, add_special_tokens=False).ids), trial
            assert int(tree.sums[1, 0]) == len(text)


def test_urls_both_ways(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "org", "/fr/"), ("block", "a.b", "/x/y")]
    hosts = ["net", "NET", "a.example.net", "example.com", "example.community", "b.org", "a.b", "c.a.b", "user@x.net:80", ""]
    paths = ["", "/", "/en", "/en/", "/EN/", "/de/x", "/fr/a/b", "/x/yz", "/x/y/", "?q=/en/", "#/"]
    given = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no url", "x://y://net/"]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(given)], "page_id long, url string, host string")

    def plain(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1].split("#")[0].split("?")[0]
        host, path = rest.split("/")[0], rest[len(rest.split("/")[0]) :]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    want = [(k, *plain(u)) for k, u in enumerate(given)]
    for size in (1 << 20, 0):
        got = urls.judge_urls(df, rules, broadcast_bytes=size).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()
        assert [tuple(g) for g in got] == want


def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 16)).astype(np.float32)
    x[100:160] = x[:60] + rng.standard_normal((60, 16)).astype(np.float32) * 0.08
    x[200:240] = x[5]
    rows = [(k, v.tolist(), "b", 1) for k, v in enumerate(x)]
    rows += [(300, None, "b", 1), (350, [0.0] * 16, "b", 1), (400, [float("nan")] + [1.0] * 15, "b", 1), (450, [None] + [1.0] * 15, "b", 1), (500, [], "b", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, bytes string, rep int").repartition(3), x


@pytest.mark.parametrize("block", [2048, 8])
def test_near_vectors(spark, block):
    df, x = vectors(spark)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.95
    label = np.arange(300)
    for _ in range(300):
        label = np.array([label[row].min() for row in link])
    got = lattice.near_vectors(df, block_rows=block).orderBy("vec_id").toPandas()
    assert got.component_id[:300].tolist() == label.tolist() and got.n_links[:300].tolist() == (link.sum(1) - 1).tolist()
    assert got.kept[300:].all() and not got.n_links[300:].any()
    assert lattice.near_vectors(df.where("false")).count() == 0


def test_lattice_points_and_recall():
    rng = np.random.default_rng(1)
    assert len(lattice.roots()) == 240
    p = lattice.nearest(rng.standard_normal((2000, 8)) * 3)
    assert np.allclose(p.sum(1) % 2, 0) and (((p - rng.permutation(p)[0]) % 1 == 0).all(1) | ((p - 0.5) % 1 == 0).all(1) | (p % 1 == 0).all(1)).all()
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1)[:, None]
    x, y = lattice.cells(a), lattice.cells(b)
    assert ((x[:, :, :1] == y).any((1, 2)) | (y[:, :, :1] == x).any((1, 2))).mean() > 0.99


@pytest.mark.parametrize("block", [4096, 16])
def test_top_k(spark, block):
    df, x = vectors(spark)
    v = np.floor(256 * x.astype(float)).astype(int)
    zero = [(350, k + 1, k, 0) for k in range(5)]  # the zero vector is a query as well: all scores are 0
    v = np.vstack([v, np.zeros_like(v[:1])])
    ids = np.append(np.arange(300), 350)
    want = []
    for at, q in [(k, k) for k in range(0, 300, 50)] + [(300, 350)]:
        s = v @ v[at]
        order = [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:5]
        want += [(q, k + 1, i, s[np.flatnonzero(ids == i)[0]]) for k, i in enumerate(order)]
    assert want[-5:] == zero
    got = topk.top_k(df, block=block, queries=block).orderBy("query_id", "rank").collect()
    assert [tuple(g) for g in got] == want
    short = df.sparkSession.createDataFrame([(k, [float(k), 1.0]) for k in range(1000, 1101)] + [(2000, [1.0] * 3), (None, [1.0, 1.0])], "vec_id long, embedding array<float>")
    both = topk.top_k(df.select("vec_id", "embedding").unionByName(short), block=block, queries=block).orderBy("query_id", "rank").collect()
    assert [tuple(g) for g in both if g.query_id < 1000] == want
    assert [(g.query_id, g.vec_id) for g in both if g.query_id >= 1000] == [(q, i) for q in (1000, 1050, 1100) for i in [i for i in range(1100, 1090, -1) if i != q][:5]]
    assert topk.top_k(df.where("false")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 200)] + [(300, 300)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 200)}} or {k: v for k, v in got.items() if k != v} == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 200)}}


def test_classifiers_learn_and_stand_edge_cases(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    odd = spark.createDataFrame([(-1, None, None), (-2, "", "en"), (-3, "x" * 100_000, "zz"), (None, "a b", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").unionByName(odd)
    for score, model, label, least in ((quality.score_quality, quality.train(docs, labels), "quality", 0.95), (toxicity.score_toxicity, toxicity.train(docs, labels), "toxic", 0.9)):
        got = score(both, model)
        assert got.count() == both.count() and got.where("score is null or score < 0 or score > 1").count() == 0
        held = got.where("held_out").join(labels, "doc_id").toPandas()
        assert (held.predicted == held[label]).mean() >= least
        assert score(both.where("false"), model).count() == 0
    full = toxicity.score_by_language(both, labels, model).toPandas()
    assert len(full) == both.count() and (full.predicted == (full.score >= 0.7)).all() and (full.flagged == (full.score >= full.lang_threshold)).all()
    known = full.merge(labels.toPandas(), on="doc_id")
    known = known[[zlib.crc32(str(int(d)).encode()) % 3 != 1 for d in known.doc_id]].assign(step=lambda x: np.floor(x.score * 1000))
    for lang, g in known.groupby("lang"):
        steps = [t for t in sorted(g.step.unique()) if g.toxic[g.step >= t].mean() >= 0.9]
        want = steps[0] / 1000 if len(g) >= 20 and steps else 0.7
        assert np.allclose(full.lang_threshold[full.lang == lang], want), lang
    assert (full.lang_threshold[full.lang.isna() | (full.lang == "zz")] == 0.7).all()
    empty = labels.where("false")
    assert quality.score_quality(odd, quality.train(docs, empty)).count() == toxicity.score_toxicity(odd, toxicity.train(docs, empty)).count() == 4


def test_pipeline_decisions(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    rows = docs.toPandas().set_index("doc_id")
    for name, stage in P.STAGES[:3]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        left = out.toPandas().set_index("doc_id")
        assert left.index.is_unique and (left.text == rows.text[left.index]).all() and len(left) > 0.5 * len(rows), name
    kept = set(near.near_duplicates(docs).where("kept").toPandas().doc_id)
    assert set(P.drop_near_duplicates(spark, docs, d).toPandas().doc_id) == kept
    cut = P.cut_repeats(spark, docs, d).toPandas().set_index("doc_id")
    want = suffixes.remove_repeats(docs).toPandas().set_index("doc_id")
    assert len(cut) == len(rows) and all((t if t is not None else "").encode() == k.decode("utf-8", "ignore").encode() for t, k in zip(cut.text, want.kept[cut.index], strict=True))
    assert P.run(spark, d).count() > 0
    assert isinstance(pd.DataFrame(), pd.DataFrame)
