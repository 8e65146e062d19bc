"""The registered queries against SQL or brute force on the smallest tables."""

import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import public_tokenizers
import corpus_pipeline
from foliant.llm import catalog, jaccard, pretoken
from oracle import assert_same


def table(sf, sql):
    return duckdb.sql(sql.replace("FROM ", f"FROM '{sf}/").replace("@", ".parquet'")).fetchall()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    assert_same(catalog.queries()[name](spark, sf), catalog.oracle_sql()[name], sf)


def brute_components(docs, k, percent):
    sets, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower))
        sets[i] = frozenset([tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([tuple(w)] if w else []))
    lists = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            lists[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, o in collections.Counter(j for g in s for j in lists[g] if j > i).items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard_against_brute_force(spark, sf, k, percent):
    docs = table(sf, "SELECT doc_id, text FROM documents@")
    words = [f"w{i}" for i in range(60)]
    extra = [(10_000 + i, " ".join(w if (j * 7 + i) % (i % 9 + 12) else f"x{i}" for j, w in enumerate(words))) for i in range(60)]
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similarity_components(frame, k, percent).collect()}
    assert got == brute_components(docs + extra, k, percent)


def test_pre_tokens_against_the_pattern():
    import random

    import regex

    rng = random.Random(1)
    texts = ["don't we'll 'tis it's's  \n\n x", "", "'s", "  ", "a" * 300, "日本語 １２３ ½", "🙂a'veb"]
    texts += ["".join(rng.choice("'stmdrevl a1.\n é \x1c") for _ in range(rng.randrange(30))) for _ in range(3000)]
    flat, _, borders, at = pretoken.split(texts)
    words = [flat[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
    for i, t in enumerate(texts):
        assert words[at[i] : at[i + 1]] == regex.findall(public_tokenizers.PATTERN, t)


def test_byte_bpe_against_tiktoken(spark, sf):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in catalog.queries()["op7_byte_bpe"](spark, sf).collect()}
    for i, t in table(sf, "SELECT doc_id, text FROM documents@"):
        ids = enc.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_long_pre_tokens_against_tiktoken():
    import tiktoken
    from foliant.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = byte_bpe.load(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    import random

    rng = random.Random(5)
    words = ["ab" * 1500, "x" * 1023, "x" * 5001, "thequickbrown" * 200, "é" * 900]
    words += ["".join(rng.choices(letters, k=n)) for letters in ("ab", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "=-_*#") for n in (1030, 2047, 6000)]
    for word in words:
        ids, _ = t.encode_words([word])
        assert ids.tolist() == enc.encode_ordinary(word)


def test_long_texts_in_pieces():
    import tiktoken
    from foliant.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = byte_bpe.load(path)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=t.ranks, special_tokens={})
    texts = ["it's  so, don't \n\n x " * 40, "word " * 50, "a" * 300, "", " \n " * 99, "é日本 ½ " * 60, "short"]
    cache = pretoken.WordCache(t.encode_words)
    for span in (7, 50, 1000):
        assert [ids.tolist() for _, ids in pretoken.encode_texts(texts, cache, span)] == [enc.encode_ordinary(x) for x in texts]
        assert ["".join(pretoken.pieces(x, span)) for x in texts] == texts


def test_hashes_do_not_depend_on_windows(monkeypatch):
    from foliant.llm import spans

    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 5000).astype(np.uint32)
    starts = np.concatenate([np.sort(rng.integers(0, 4900, 700)), np.sort(rng.integers(0, 4900, 300))])
    ends = starts + rng.integers(0, 100, 1000)
    whole = spans.span_hashes(values, starts, ends)
    monkeypatch.setattr(spans, "WINDOW", 64)
    assert all((a == b).all() for a, b in zip(whole, spans.span_hashes(values, starts, ends)))


def test_wavelet_shards(spark, sf):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, at = {r["doc_id"]: r for r in catalog.queries()["op6_wavelet_shards"](spark, sf).collect()}, 0
    for i, t in sorted(table(sf, "SELECT doc_id, text FROM documents@")):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = dict(table(sf, "SELECT doc_id, quality FROM labels@"))
    rows = [r for r in catalog.queries()["op3_quality_classifier"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.93


def test_sharding_covers_all_rows(spark, sf):
    rows = catalog.queries()["op5_ring_sharding"](spark, sf).collect()
    n = collections.Counter(r["shard"] for r in rows)
    assert set(n) <= set(range(16)) and max(n.values()) - min(n.values()) <= 1
    texts = dict(table(sf, "SELECT doc_id, text FROM documents@"))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_sharding_against_a_walk_of_the_ring(spark, sf, slack):
    """Key by key: a row sits in its own arc's shard while there is room, then walks clockwise to the next with room."""
    import bisect

    from foliant.llm import ring_sharding

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    frame = frame.select("doc_id", "text").union(frame.limit(40).selectExpr("doc_id + 90000", "'same text for all'"))
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in ring_sharding.assign_shards(frame, slack=slack).collect()}
    rows = frame.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS at").collect()
    nodes, caps, n = ring_sharding.ring(16, 64), [0] * 16, len(rows)
    for seat in range(int(n * (1 + slack))):
        caps[seat % 16] += 1
    order = [place for place, _ in nodes]
    arcs = sorted((bisect.bisect_left(order, r["at"]) % len(nodes), r["doc_id"], r["at"]) for r in rows)
    taken, shard, late = [0] * 16, {}, []
    for arc, doc, _ in arcs:
        own = nodes[arc][1]
        if taken[own] < caps[own]:
            shard[doc] = (own, taken[own])
            taken[own] += 1
        else:
            late.append((arc, doc))
    for arc, doc in late:
        while taken[nodes[arc % len(nodes)][1]] >= caps[nodes[arc % len(nodes)][1]]:
            arc += 1
        own = nodes[arc % len(nodes)][1]
        shard[doc] = (own, taken[own])
        taken[own] += 1
    assert got == shard


def test_mixing_against_a_model_of_targets(spark, sf):
    """Sizes, targets and the cap of every document of the table, and how near the words come."""
    import re

    from test_small_cases import water

    rows = table(sf, "SELECT doc_id, text, source FROM documents@")
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    sources = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, _, s in rows)
    of = {i: s for i, _, s in rows}
    sums = [sum(size[i] for i in of if of[i] == s) for s in sources]
    target = dict(zip(sources, water(sums, [(5, 2, 1)[k % 3] for k in range(len(sources))], 3)))
    got = catalog.queries()["op9_mixing"](spark, sf).collect()
    assert {r["doc_id"]: r["size"] for r in got} == size and len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sums[sources.index(of[r["doc_id"]])] and r["target"] == pytest.approx(target[of[r["doc_id"]]])
        assert r["taken"] in {k * r["size"] for k in range(4)}
        taken[of[r["doc_id"]]] += r["taken"]
    for s in sources:  # 200 documents can be cut no finer
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20


def test_licences_against_a_loop(spark, sf):
    from test_small_cases import assert_like_the_model

    rows = catalog.queries()["op8_license_scan"](spark, sf).collect()
    texts = dict(table(sf, "SELECT doc_id, text FROM documents@"))
    assert_like_the_model(rows, texts)


def test_planted_licence_lines(spark):
    """Whole lines that are a template are confirmed as its family; nothing else is."""
    from foliant.llm import license_scan

    sf = "/root/testdata/sf0.01"
    family = {t: k for k, ts in license_scan.TEMPLATES.items() for t in ts} | {"All rights reserved.": "proprietary"}
    want = {(d, i): family[x] for d, t in table(sf, "SELECT doc_id, text FROM documents@") for i, x in enumerate((t or "").split("\n")) if x in family}
    got = {(r["doc_id"], r["paragraph"]): r["family"] for r in catalog.queries()["op8_license_scan"](spark, sf).where("confirmed").collect()}
    assert len(want) > 40 and got == want


def test_hnsw_against_brute_force(spark, sf):
    rows = table(sf, "SELECT vec_id, embedding, label FROM embeddings@")
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in catalog.queries()["op10_hnsw_near_dedup"](spark, sf).collect()}
    assert got == {r[0]: int(n) for r, n in zip(rows, near.sum(1))}


def test_native_plans_have_no_python(spark, sf):
    for name in ("op2_chat_format", "op5_ring_sharding", "op8_license_scan", "op9_mixing"):
        plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow|MapIn", plan), name


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r[0] for r in docs.select("doc_id").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
    copies = collections.Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert collections.Counter(r["doc_id"] for r in out.select("doc_id").collect()) == copies
    assert set(copies) <= ids and max(copies.values()) <= 3


def test_pipeline_stages_against_brute_force(spark, sf):
    """Copies and near copies are gone, and nothing else, whatever the classifier keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = dict(table(sf, "SELECT doc_id, text FROM documents@"))
    best = {t: i for i, t in sorted(texts.items())}
    once = corpus_pipeline.drop_copies(spark, docs, sf)
    assert {r["doc_id"] for r in once.collect()} == set(best.values())
    left = {i: texts[i] for i in best.values()}
    want = {i for i, (_, c) in brute_components(list(left.items()), 5, 80).items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, once, sf).collect()} == want
