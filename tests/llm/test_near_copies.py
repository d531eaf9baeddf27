import random

import numpy as np

from tests.llm.test_operators import fingerprint_brute
from vellumite.llm import simhash


def shingles_brute(text):
    parts = text.split()
    return {tuple(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))}


def test_near_copies_beyond_three_bits(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]

    def edited(text, n):
        parts = text.split()
        for i in rng.sample(range(len(parts)), n):
            parts[i] = rng.choice(vocab)
        return " ".join(parts)

    texts = []
    for k in range(120):
        texts.append(" ".join(rng.choice(vocab) for _ in range(rng.randint(150, 400))))
        texts.append(edited(texts[-1], len(texts[-1].split()) * (k % 8) // 200 + 1))
    family = " ".join(rng.choice(vocab) for _ in range(200))
    texts += [family + f" tail{i}" for i in range(60)] + [edited(family, rng.randint(1, 8)) for _ in range(60)]  # one large cell in all bands
    sets, fps = [shingles_brute(t) for t in texts], [fingerprint_brute(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            like = both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both)
            bits = (int(fps[i], 16) if isinstance(fps[i], str) else fps[i]) ^ (int(fps[j], 16) if isinstance(fps[j], str) else fps[j])
            wide += like and bits.bit_count() > 3
            if like or bits.bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert wide > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.one_of_each(docs).collect()) == [i for i in range(len(texts)) if find(i) == i]


def test_shingles_of_few_words():
    assert len(simhash.shingles(None)) == 0 and len(simhash.shingles(b" \n")) == 0
    assert len(simhash.shingles(b"a b")) == 1 and len(simhash.shingles(b"a b c d e")) == 1 and len(simhash.shingles(b"a b c d e f")) == 2


def test_blocks_find_every_link(spark):
    """Cells dealt to many small blocks: what is linked is connected as by all pairs."""
    rng = random.Random(5)
    rows, sets = [], {}
    for node in range(90):
        base = node % 6
        sets[node] = np.unique(np.array([base * 1000 + i for i in range(40) if rng.random() < 0.93], np.uint64))
        rows += [(cell, node, node, 45) for cell in (1, 2) if node % 2 == cell - 1]
    members = spark.createDataFrame(rows, "cell long, node long, component long, n long")
    stored = spark.createDataFrame([(k, v.tobytes()) for k, v in sets.items()], "node long, set binary")
    got = {(r.a, r.b) for r in simhash._block_links(members, stored, most=7, most_bytes=3000).collect()}
    alike = {(a, b) for a in sets for b in range(a + 1, 90) if a % 2 == b % 2 and simhash.similar(sets[a], sets[b])}
    assert got <= alike

    def groups(links):
        root = list(range(90))
        for a, b in sorted(links):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        def top(i):
            while root[i] != i:
                i = root[i]
            return i
        return [top(i) for i in range(90)]

    assert groups(got) == groups(alike)
