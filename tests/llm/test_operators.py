"""Each operator against a brute-force version on rough rows, on empty tables, and on small driver tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumite.llm import byte_bpe, exact_dedup, gated_lm, language_id, packing, quality_rules, sharding, simhash, suffix_dedup, toxicity
from vellumite.llm.common import ROW
from vellumite.llm.components import components
from vellumite.tables import table

WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def same(df, sql, sf_dir, key="doc_id"):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    a = df.toPandas().sort_values(key).reset_index(drop=True)
    b = con.sql(sql).df().sort_values(key).reset_index(drop=True)[list(a.columns)]
    assert len(a) == len(b) > 0
    assert a.astype(str).equals(b.astype(str))


# 1. Language model


def test_lm_counts_and_base(rough, rough_rows):
    got = gated_lm.lm_scores(rough, sample_tokens=2000, frequent=20).collect()
    tokens = [(i, re.findall(WORD, lower(t or "")) + ["\n"]) for i, t, *_ in rough_rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_lm_beats_base_on_held_out(spark, sf_dir):
    r = gated_lm.op1_gated_lm(spark, sf_dir).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_lm_is_a_distribution():
    """Over all frequent words and ending classes, the probabilities of the next symbol add up to one."""
    vocab = gated_lm.Vocabulary([f"w{i}".encode() for i in range(30)] + [gated_lm.END], np.array([*range(40, 10, -1), 5.0]), np.ones(gated_lm.ENDINGS), np.ones(gated_lm.ENDINGS), 1000, 100)
    net = gated_lm.Network(vocab)
    rng = np.random.default_rng(0)
    net.train([rng.integers(0, 31, 50) for _ in range(20)], epochs=1, lanes=4, window=8)
    symbols = 31 + gated_lm.ENDINGS
    scores = net.scores([np.array([3, s]) for s in range(symbols)]) - net.scores([np.array([3])] * symbols)
    assert abs((10**scores).sum() - 1) < 1e-4


def test_lm_state_runs_through_windows_and_lanes():
    vocab = gated_lm.Vocabulary([f"w{i}".encode() for i in range(30)], np.arange(40, 10, -1.0), np.ones(gated_lm.ENDINGS), np.ones(gated_lm.ENDINGS), 1000, 100)
    net = gated_lm.Network(vocab)
    rng = np.random.default_rng(1)
    for k in ("wc", "ww"):
        net.p[k] = rng.standard_normal(net.p[k].shape).astype(np.float32)
    docs = [rng.integers(0, 30, n) for n in (1, 200, 7, 64, 65, 3)]
    whole = net.scores(docs)
    assert np.allclose(whole, net.scores(docs, lanes=1, window=1000), rtol=1e-4)
    assert np.allclose(whole, [net.scores([d], lanes=1, window=3)[0] for d in docs], rtol=1e-4)


def test_lm_gradient():
    vocab = gated_lm.Vocabulary([f"w{i}".encode() for i in range(12)], np.arange(40, 28, -1.0), np.ones(gated_lm.ENDINGS), np.ones(gated_lm.ENDINGS), 1000, 100)
    net = gated_lm.Network(vocab, embed=6, hidden=8)
    docs = [np.tile([1, 5, 2, 7], 30) for _ in range(8)]
    before = net.scores(docs).sum()
    for _ in range(4):
        net.train(docs, epochs=8, lanes=4, window=12, rate=0.02)
    assert net.scores(docs).sum() > 0.3 * before  # a repeated pattern is learned


# 2. Packing


def check_packed(got, want, limit=4096):
    """got: rows of pieces; want: multiset of whole id sequences."""
    per_sequence = defaultdict(list)
    for r in got:
        per_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in per_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= limit
    pieces = Counter((str(r.doc_id), r.start, bytes(r.ids)) for r in got)
    for doc_id, ids in want:
        a = 0
        while a < len(ids):
            fits = [k for k in pieces if k[0] == doc_id and k[1] == a and pieces[k] and np.array(ids[a : a + len(k[2]) // 4], "<u4").tobytes() == k[2]]
            assert fits, (doc_id, a)
            pieces[fits[0]] -= 1
            a += len(fits[0][2]) // 4
    assert not +pieces


def test_packing_rough(rough, rough_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    want = [(str(i), t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x, *_ in rough_rows]
    check_packed(packing.pack_documents(rough).collect(), want)


def test_packing_little_padding(spark, sf_dir):
    r = packing.op2_packing(spark, sf_dir).groupBy().agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert r.n > 0.95 * 4096 * (r.s - 1)


def test_packing_limits():
    limits = packing.Limits(tokens=100, segments=3, loss=40)
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 350, 60).tolist()
    loss = [np.concatenate([[0], np.cumsum(rng.random(n) < 0.6)]) for n in sizes]
    pieces = packing.packed(sizes, loss, limits, min_cut=4)
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence].append(p)
    for own in by.values():
        assert len(own) <= 3 and sum(p.length for p in own) <= 100
        assert sum(int(loss[p.example][p.start + p.length] - loss[p.example][p.start]) for p in own) <= 40
    covered = defaultdict(list)
    for p in pieces:
        covered[p.example].append((p.start, p.length))
    for e, n in enumerate(sizes):
        at = 0
        for a, length in sorted(covered[e]):
            assert a == at
            at += length
        assert at == n


# 3. Exact deduplication


@pytest.mark.parametrize("budget", [96 << 20, 2000])
def test_exact_rough(rough, rough_rows, budget):
    groups = defaultdict(list)
    for i, t, *_ in rough_rows:
        groups[re.sub(WS, " ", t or "")].append((1, 0) if i is None else (0, i))
    want = sorted((str(i if not none else None), str(min(g)[1] if not min(g)[0] else None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for none, i in g)
    got = exact_dedup.exact_dedup(rough, budget=budget, bits=2).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)
    stay = exact_dedup.without_copies(rough, budget=budget, bits=2)
    assert stay.columns == rough.columns and stay.count() == len(groups)


def test_exact_sql(spark, sf_dir):
    same(exact_dedup.op3_exact_dedup(spark, sf_dir), exact_dedup.ORACLE, sf_dir)


def test_open_table_compares_content():
    t = exact_dedup.OpenTable(4)
    from array import array

    for k in range(50):
        t.add(7, b"%d" % (k % 25), array("q", (k, k, 1)))  # one hash for all
    assert len(t.contents) == 25 and all(len(m) == 6 for m in t.members)


def test_grace_ends_when_hashes_are_equal():
    from array import array

    g = exact_dedup.GraceGroups(budget=10, bits=4)
    for k in range(40):
        g.add(5, b"content %d" % (k % 20), array("q", (k, k, 1)))
    assert sorted(len(m) for _, _, m in g.groups()) == [6] * 20


# 4. Language


def test_language_rough(rough, rough_rows):
    got = language_id.language_id(rough).collect()
    assert len(got) == len(rough_rows)
    by = {r.doc_id: r for r in got}
    for i in (24, 25, 26, 27):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in got)
    assert all(by[i].lang_pred == ("en" if i % 2 else "fr") for i in range(24))
    kept = language_id.in_known_language(rough)
    assert kept.columns == rough.columns
    assert kept.where("doc_id in (24, 25, 26, 27)").count() == 0 and kept.where("doc_id < 24").count() == 24


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    r = language_id.op4_language_id(spark, d).join(table(spark, d, "documents"), "doc_id").where("held_out")
    assert r.where("lang_pred = lang").count() >= 0.97 * r.count()
    assert all((zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r.select("doc_id").collect())


def test_bundle_is_the_sum_of_bound_letters():
    store = language_id.TrigramVectors(64)
    keys, counts = language_id.trigrams("Ab, ab")
    spelled = Counter((k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF) for k, c in zip(keys.tolist(), counts.tolist()) for _ in range(c))
    a, b = ord("a"), ord("b")
    assert spelled == Counter({(0, a, b): 2, (a, b, 0): 2, (b, 0, a): 1})
    v = sum(n * np.roll(store.letter(x), 2) * np.roll(store.letter(y), 1) * store.letter(z) for (x, y, z), n in spelled.items())
    assert np.allclose(counts @ store.of(keys), v)


def test_vector_store_is_refilled():
    small, large = language_id.TrigramVectors(32, limit=10), language_id.TrigramVectors(32)
    for text in ("the cat sat on a mat", "le chat", "the cat", "a very long text about nothing at all"):
        keys, _ = language_id.trigrams(text)
        assert np.allclose(small.of(keys), large.of(keys))


# 5. Sharding


def test_shards_rough(rough, rough_rows):
    got = sharding.sharded(rough, sharding.tree(16), sharding.tree(17), bucket_rows=1).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rough_rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_move_rows_only_into_the_changed_subtree(spark):
    ids = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    old = sharding.tree(16)
    new = [sharding.Leaf(x.region, x.rack, x.shard, 2.0 if x.shard == 5 else 1.0) for x in old]
    df = sharding.assigned(sharding.assigned(ids, F.col("k"), old, "a"), F.col("k"), new, "b").where("a <> b").collect()
    assert df and all(r.b // 8 == 0 for r in df)  # movers land in the region whose weight rose
    assert all(r.b // 4 == 1 for r in df if r.a // 8 == 0)  # inside it, in the rack
    assert all(r.b == 5 for r in df if r.a // 4 == 1)  # inside that, in the shard


def test_shard_shares_follow_weights(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    leaves = [sharding.Leaf("a", "x", 0, 1.0), sharding.Leaf("a", "y", 1, 2.0), sharding.Leaf("b", "z", 2, 1.0)]
    n = {r.s: r["count"] for r in sharding.assigned(ids, F.col("k"), leaves, "s").groupBy("s").count().collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] - n[2]) < 600


# 6. Quality rules


def quality_brute(text):
    ws = re.findall(WORD, text or "")
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    counts = Counter(tri)
    covered = {j for i, t in enumerate(tri) if counts[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(ws) < 50 or 100 * len(covered) > 50 * len(ws)


def test_quality_rough(rough, rough_rows):
    got = quality_rules.quality_rules(rough).collect()
    want = sorted((str(i), *quality_brute(t)) for i, t, *_ in rough_rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_sql(spark, sf_dir):
    same(quality_rules.op6_quality_rules(spark, sf_dir), quality_rules.ORACLE, sf_dir)


def test_quality_keeps_clean_rows(spark):
    d = "/root/testdata/sf0.01"
    df = quality_rules.op6_quality_rules(spark, d).join(table(spark, d, "labels"), "doc_id").where("NOT base_failed")
    clean, junk = df.where("quality = 1"), df.where("quality = 0")
    assert clean.where("kept").count() >= 0.98 * clean.count()
    assert junk.where("kept").count() <= 0.1 * junk.count()


def test_quality_stays_in_the_engine(spark, sf_dir):
    plan = quality_rules.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# 7. Suffix array


def passages_brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def test_passages_rough(rough, rough_rows):
    got = suffix_dedup.suffix_dedup(rough).collect()
    want = passages_brute([(t or "").encode() for _, t, *_ in rough_rows], 400)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got) == sorted((str(x[0]), *w) for x, w in zip(rough_rows, want))
    left = suffix_dedup.without_repeats(rough)
    assert left.columns == rough.columns and left.where("text IS NOT NULL").where("n_chars <> length(text)").count() == 0


def test_passages_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").toPandas()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == dict(zip(docs.doc_id, passages_brute([t.encode() for t in docs.text], 400)))


def test_refinement_against_sorting():
    rng = np.random.default_rng(0)
    block = rng.integers(97, 100, 300).astype(np.uint8).tobytes()
    pieces = [block[:200], rng.integers(97, 100, 150).astype(np.uint8).tobytes(), block[50:260], b"ab" * 80, block[60:180]]
    seen = Counter(p[i : i + 40] for p in pieces for i in range(len(p) - 39))
    want = [[seen[p[i : i + 40]] > 1 for i in range(len(p) - 39)] for p in pieces]
    assert [f.tolist() for f in suffix_dedup.repeated(pieces, 40)] == want


@pytest.mark.parametrize("crowd", [1, 3, 12])
def test_one_minimiser_with_very_many_contexts(spark, crowd):
    rng = np.random.default_rng(1)
    word = lambda n: "".join(chr(c) for c in rng.integers(97, 123, n))
    passage, shorter = word(700), word(390)
    few = [word(60) for _ in range(4)]
    texts = [word(500) + passage[k % 3 :] + word(450) for k in range(20)]
    texts += [word(200) + few[k % 4] + shorter + few[k % 3] + word(300) for k in range(40)]
    texts += texts[:5] + [passage, "", None, "ab" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(df, crowd=crowd).collect()}
    assert got == dict(enumerate(passages_brute([(t or "").encode() for t in texts], 400)))


def test_parts_of_a_context():
    body = bytes(np.random.default_rng(3).integers(97, 123, 150).astype(np.uint8))
    for width in (1, 16):
        found = list(suffix_dedup.parts(body, 70, width, 60))
        assert sorted(s for a, z, *_ in found for s in range(a, z + 1)) == list(range(len(body) - 59))
        for a, z, core, piece in found:
            assert piece == body[a : z + 60] and all(core.split(b" ", 1)[1] in body[s : s + 60] for s in range(a, z + 1))


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    text = bytes(np.random.default_rng(2).integers(97, 123, 5000).astype(np.uint8))
    starts = sorted((a, z) for _, a, z, _, _ in suffix_dedup._all_contexts([text, b"short"], 400, 64))
    assert [a for a, _ in starts] == [0, *[z + 1 for _, z in starts[:-1]]] and starts[-1][1] == len(text) - 400


# 8. SimHash


def fingerprint_brute(text, n=3):
    import xxhash

    ws = re.findall(WORD, lower(text or ""))
    shingles = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_brute(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_rough(rough, rough_rows):
    got = simhash.simhash_groups(rough).collect()
    fps = [fingerprint_brute(t) for _, t, *_ in rough_rows]
    label = groups_brute(fps)
    least = {x: min(((r[0] is None, r[0]) for r, y in zip(rough_rows, label) if y == x)) for x in set(label)}
    want = sorted((str(r[0]), f, str(least[x][1])) for r, f, x in zip(rough_rows, fps, label))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    stay = simhash.one_of_each(rough)
    assert stay.columns == rough.columns and stay.count() == len(set(label))


def test_links_of_dense_families(spark):
    rng = np.random.default_rng(4)
    fps = set()
    for _ in range(12):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(60):
            y = x
            for b in rng.integers(0, 64, int(rng.integers(0, 5))):
                y ^= 1 << int(b)
            fps.add(y)
    fps = sorted(fps)
    label = groups_brute(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3))
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links.collect())
    found = {r.node & (1 << 64) - 1: r.component for r in components(links).collect()}
    named = defaultdict(set)
    for f, x in zip(fps, label):
        named[x].add(found.get(f, f"alone {f}"))
    assert all(len(v) == 1 for v in named.values()) and len(set.union(*named.values())) == len(named)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 500)).astype(np.uint64)
    assert (simhash.manhattan(simhash.embedded(a), simhash.embedded(b)) <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 5), (100, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60)) and got[100] == 0


# 9. Toxicity


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    df = toxicity.op9_toxicity(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    pos, neg = df[df.toxic == 1].score.values, df[df.toxic == 0].score.values
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert auc > 0.9 and (neg >= 0.5).mean() < 0.02 and (pos >= 0.5).mean() > 0.7
    assert ((df.score >= 0.5) == (df.predicted == 1)).all()


def test_toxicity_rough(spark, rough, rough_rows):
    labels = spark.createDataFrame([(i, i % 2, None if i % 7 == 0 else int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    got = toxicity.scored(rough, toxicity.learn(rough, labels)).collect()
    assert len(got) == len(rough_rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.scored(rough, toxicity.learn(rough, labels.where("false"))).collect()
    assert all(r.score == 0 for r in none)


def test_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    y = (rng.random(500) < x).astype(float)
    at, level = toxicity.isotonic(x, y)
    assert (np.diff(level) >= -1e-12).all() and (np.diff(at) >= 0).all()
    assert abs(np.interp(0.8, at, level) - 0.8) < 0.15


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert (((toxicity.Trees().fit(x, y).margins(x) > 0) == (y > 0)).mean()) > 0.95


# 10. Byte-level BPE


def reference_codec():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.vocabulary_path()), special_tokens={})


def test_bpe_rough(rough, rough_rows):
    codec = reference_codec()
    want = []
    for i, t, *_ in rough_rows:
        ids = codec.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.byte_bpe(rough).collect()) == sorted(want)


@pytest.mark.parametrize("limits", [{}, {"limit": 5}, {"limit": 1}, {"long_bytes": 4}])
def test_bpe_codec(limits):
    import public_tokenizers

    codec, known = byte_bpe.BpeCodec(byte_bpe.vocabulary_path(), public_tokenizers.PATTERN, **limits), reference_codec()
    texts = ["", " ", "  a  b\n\n c\t\td ", "don't we'LL I've", "naïve café  x", "\x1c\x85  z", "aaaaaaaaaaaaaaa" * 9, "日本語のテキスト 123456 #!?", "é\U0001f600\x00", "Thntblere\nof  then,  edtioner \r\n in"]
    for t, (ids, raw) in zip(texts, codec.encode(texts)):
        assert ids == ",".join(map(str, known.encode_ordinary(t))) and raw == t.encode()


def test_bpe_table(spark, sf_dir):
    codec = reference_codec()
    got = {r.doc_id: r for r in byte_bpe.op10_byte_bpe(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").collect():
        ids = codec.encode_ordinary(r.text)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


# Empty tables


def test_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        gated_lm.lm_scores(nothing), packing.pack_documents(nothing), exact_dedup.exact_dedup(nothing), exact_dedup.without_copies(nothing), language_id.language_id(nothing),
        language_id.in_known_language(nothing), sharding.sharded(nothing, sharding.tree(16), sharding.tree(17)), quality_rules.quality_rules(nothing), suffix_dedup.suffix_dedup(nothing),
        suffix_dedup.without_repeats(nothing), simhash.simhash_groups(nothing), simhash.one_of_each(nothing), toxicity.scored(nothing, toxicity.learn(nothing, labels)), byte_bpe.byte_bpe(nothing),
    ):
        assert df.collect() == []
    assert ROW.startswith("_")
