import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from common import SCHEMA, clash, corpus, sentence
from pyspark.sql import functions as F

from lodestrata.llm import blocks, embedding_dedup, lm_scoring, ngram_join, suffix_dedup, token_counts, toxicity
from lodestrata.llm.components import connected_components
from lodestrata.llm.scratch import Scratch


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 8_000)


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)]
    found = {r.id: r.root for r in connected_components(spark.createDataFrame(pairs + [(5, 5)], "a long, b long"), Scratch(spark, "cc")).collect()}
    want = roots(pairs, {x for p in pairs for x in p})
    assert {n: found.get(n, n) for n in want} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0


@pytest.mark.parametrize("tile", [3, 2048])
def test_embeddings_equal_brute_force(spark, tile):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(150):
        v = base[k % 12] + rng.normal(size=16) * (0, 0.05, 0.2, 0.3)[k % 4]
        rows.append((k, [float(np.float32(x)) for x in v], (0, 1, None)[k % 3] if k % 10 else 0))
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 16, 0), (203, [float("nan")] + [1.0] * 15, 0), (204, [None] + [1.0] * 15, 0), (205, [float("inf")] * 16, 0), (206, [1.0, 2.0], 0), (207, [2.0, 4.0], 0)]
    rows += [rows[3], rows[12][:1] + rows[12][1:]]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = collections.defaultdict(list)
    for r in embedding_dedup.near_duplicates(df, Scratch(spark, "e"), tile=tile).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))

    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v)
        return v / np.sqrt(v @ v)

    units = [unit(v) for _, v, _ in rows]
    links = collections.defaultdict(list)
    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93:
                links[i].append(j)
                links[j].append(i)
    comp = roots([(rows[i][0], rows[j][0]) for i in links for j in links[i]], {r[0] for r in rows})
    want = collections.defaultdict(list)
    for i, (v, _, _) in enumerate(rows):
        want[v].append((len(links[i]), comp[v], comp[v] == v))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    assert sum(map(len, links.values())) > 100


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), Scratch(spark, "e")).count() == 0


UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))


def test_jaccard_equals_brute_force(spark):
    rng = random.Random(8)
    rows = corpus()
    base = sentence(rng, 60).split()
    for k in range(80):  # near copies around the threshold, some far from one another
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"w{rng.randrange(6)}"
        rows.append((1000 + k, " ".join(w), "en", "s1"))
    sets = []
    for d, t, _, _ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    pairs = [(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    comp = roots(pairs, {r[0] for r in rows})
    got = ngram_join.similar_documents(clash(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "n")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((r[0], len(s), comp[r[0]]) for r, s in zip(rows, sets, strict=True))


def test_jaccard_of_nothing(spark):
    assert ngram_join.similar_documents(spark.createDataFrame([], SCHEMA), Scratch(spark, "n")).count() == 0


def test_overlaps_are_derived_right():
    rng = random.Random(3)
    target = np.unique(np.array([rng.randrange(1000) for _ in range(300)], np.uint64))
    base = {rng.randrange(1000) for _ in range(200)}
    others = []
    for _ in range(30):
        base = (base - {rng.choice(sorted(base))}) | {rng.randrange(1000)}
        others.append(np.array(sorted(base), np.uint64))
    assert ngram_join._overlaps(target, others) == [len(set(target.tolist()) & set(o.tolist())) for o in others]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    rng = random.Random(9)
    parts = [" ", "  ", "▁", "a", "é", "the", "<s>", "</s>", "<0x0A>", "\n", "\t", "日本", "😀", "x" * 300, "ing", " " * 40, "▁" * 13, "\x00"]
    rows = corpus() + [(5000 + k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "en", "s") for k in range(300)]
    model = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    got = token_counts.count_tokens(clash(spark.createDataFrame(rows, SCHEMA)), model).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((d, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for d, t, _, _ in rows)
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_toxicity_learns_words_and_stems(spark):
    rng = random.Random(10)
    rows = []
    for k in range(900):
        bad = k % 7 == 0
        w = sentence(rng, rng.randint(5, 80)).split()
        if bad:
            w[rng.randrange(len(w))] = rng.choice(("zorgish", "zorgful", "blarg"))
        rows.append((k, " ".join(w), ("en", "de")[k % 2], "s", int(bad)))
    docs = spark.createDataFrame(rows, SCHEMA + ", toxic int")
    labels = docs.filter("doc_id < 600").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.drop("toxic"), labels.union(labels.limit(3)))
    scored = toxicity.score(clash(docs.drop("toxic")), model)
    got = {r.doc_id: r.score for r in scored.collect()}
    right = sum((got[r[0]] >= toxicity.THRESHOLD) == bool(r[4]) for r in rows[600:])
    assert right >= 295
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "xx", "s"), (3, "zorgdom " * 30_000, "en", "s")], SCHEMA)
    out = {r.doc_id: r for r in toxicity.score(odd, model).collect()}
    assert out[1].score == out[2].score < 0.3 <= out[3].score
    assert toxicity.score(docs.drop("toxic").limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int"))
    assert toxicity.score(docs, model).filter("score > 0.01 or rejected").count() == 0


def fifth():
    def held_out(ids):  # a local function travels to the workers by value
        return np.array([zlib.crc32(str(x).encode()) % 5 == 1 for x in ids.to_pylist()], bool)

    return held_out


def test_lm_scores(spark, small_blocks):
    rows = corpus(n=150)
    got = lm_scoring.score_documents(clash(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "lm"), fifth()).collect()
    tokens = [[*words(t), "\0end"] for _, t, _, _ in rows]
    held = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows]
    counts = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((r[0], h, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws), 6)) for r, ws, h in zip(rows, tokens, held, strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm_scoring.score_documents(spark.createDataFrame([], SCHEMA), Scratch(spark, "lm"), fifth()).count() == 0


def plain_tree(tokens, train, depth, least, nats):
    """log10 probability of each token sequence under the suffix tree, from dictionaries of whole contexts."""
    follows = [collections.defaultdict(collections.Counter) for _ in range(depth + 1)]
    for ws, learn in zip(tokens, train, strict=True):
        seq = [None, *ws]
        for i in range(1, len(seq)):
            for d in range(min(depth, i) + 1):
                if learn:
                    follows[d][tuple(seq[i - d : i])][seq[i]] += 1
    root = follows[0][()]
    total, kinds = sum(root.values()), len(root)
    memo = {}

    def retained(ctx):
        if ctx not in memo:
            seen = follows[len(ctx)].get(ctx, {})
            n, t = sum(seen.values()), len(seen)
            if n < least:
                memo[ctx] = None
            else:
                old = {w: p(w, ctx[1:]) for w in seen}
                new = {w: (seen[w] + t * old[w]) / (n + t) for w in seen}
                share = t / (n + t)
                gain = sum(new[w] * math.log(new[w] / old[w]) for w in seen) + share * max(1 - sum(old.values()), 0) * math.log(share)
                memo[ctx] = (n, t) if gain >= nats else None
        return memo[ctx]

    def p(w, ctx):
        if not ctx:
            return (root[w] + 0.5) / (total + 0.5 * (kinds + 1))
        below = p(w, ctx[1:])
        state = retained(ctx)
        return (follows[len(ctx)][ctx][w] + state[1] * below) / sum(state) if state else below

    return [sum(math.log10(p(w, tuple([None, *ws][max(0, i + 1 - depth) : i + 1]))) for i, w in enumerate(ws)) for ws in tokens]


@pytest.mark.parametrize(("depth", "least"), [(0, 2), (1, 2), (2, 6), (4, 2), (7, 3)])
def test_lm_scores_equal_a_plain_tree(spark, small_blocks, depth, least):
    rng = random.Random(depth)
    rows = corpus(n=150) + [(None, "a b a c a b a d " * 30, "en", "s"), (900, "a b a c x " * 20, "en", "s")]
    rows += [(1000 + k, " ".join(rng.choice(("a b c", "a b d", "x a b c e")) for _ in range(20)), "en", "s") for k in range(40)]
    got = collections.defaultdict(list)
    for r in lm_scoring.score_documents(clash(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "lm"), fifth(), depth=depth, least=least).collect():
        got[r.doc_id].append(r.score)
    tokens = [[*words(t), "\0end"] for _, t, _, _ in rows]
    want = collections.defaultdict(list)
    for r, x in zip(rows, plain_tree(tokens, [zlib.crc32(str(r[0]).encode()) % 5 != 1 for r in rows], depth, least, lm_scoring.DIVERGENCE), strict=True):
        want[r[0]].append(x)
    assert set(got) == set(want)
    for k, x in want.items():
        assert sorted(got[k]) == pytest.approx(sorted(x), rel=1e-6)


def test_lm_states_are_distributions(spark):
    """Next-word probabilities after a frequent context sum to one over the words and one unknown."""
    text = "a b a c a b a d " * 40
    vocabulary = ["a", "b", "c", "d"]
    rows = [(k, text, "en", "s") for k in range(5) if zlib.crc32(str(k).encode()) % 5 != 1]
    probes = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows += [(probes[k], f"a {w}", "en", "s") for k, w in enumerate([*vocabulary, "unknown"])] + [(probes[5], "a", "en", "s")]
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "lm"), fifth()).collect()}
    assert got[probes[1]] > got[probes[0]] and got[probes[1]] > got[probes[2]]
    assert all(x < 0 for x in got.values())


def test_passages_equal_brute_force(spark, small_blocks):
    rows = corpus(n=90) + [(300, "ab" * 400, "en", "s"), (301, "zz" + "ab" * 60, "en", "s"), (302, "x" * 49, "en", "s"), (303, "x" * 49, "en", "s")]
    got = suffix_dedup.remove_repeats(clash(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "s"), with_text=True).collect()
    first, want = {}, []
    for d, t, _, _ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], d) < d:
                mask[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, mask, strict=True) if not y)
        want.append((d, len(b), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(kept).hexdigest(), kept))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got) == sorted(want)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert sum(r.n_removed for r in got) > 1000
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA), Scratch(spark, "s")).count() == 0


def test_loser_tree_merges_with_right_prefixes():
    rng = random.Random(12)
    for _ in range(30):
        runs = [sorted(bytes(rng.choice(b"ab\0") for _ in range(12)) for _ in range(rng.randint(0, 15))) for _ in range(rng.randint(1, 7))]
        coded = [(r, suffix_dedup.common_prefixes(np.frombuffer(b"".join(r), np.uint8).reshape(-1, 12)).tolist()) for r in runs]
        run, place, common = suffix_dedup.merge_runs(coded)
        merged = [runs[a][b] for a, b in zip(run, place, strict=True)]
        assert merged == sorted(x for r in runs for x in r)
        for x, y, k in zip(merged, merged[1:], common[1:], strict=False):
            assert k == next((i for i in range(12) if x[i] != y[i]), 12)


def test_front_coding_round_trip():
    rows = np.unique(np.random.default_rng(1).integers(0, 3, (200, 9), np.uint8), axis=0)
    common, tails = suffix_dedup.front_coded(rows)
    out = suffix_dedup.decoded(blocks.unpack(common, np.uint8), blocks.unpack(tails, np.uint8).tobytes(), 9)
    assert out == [r.tobytes() for r in rows]
