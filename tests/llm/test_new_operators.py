"""Fill-in-middle, collocations and the range join of embeddings against brute force; ties of the toxicity threshold."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from egresslake.llm import collocations, fill_in_middle, range_join, toxicity
from tests.llm.conftest import edge_rows, vector_rows

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_boundaries_are_token_ends():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab \t\nü😀\x0b ") for _ in range(rng.randint(0, 12)))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        assert fill_in_middle.boundaries(codes).tolist() == [m.end() for m in TOKEN.finditer(text)]


def test_fill_in_middle_of_edge_table(spark, edge):
    docs = edge.drop("n")
    out = fill_in_middle.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = out.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(rows) == len(edge_rows()) and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        text = r.text or ""
        tokens = TOKEN.findall(text)
        h = hashlib.sha256(f"42:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "plain" if not text or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output, r.again) == (len(tokens), form, want, text)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))


def test_markers_in_texts_and_at_cuts(spark):
    texts = ["a <P> b", "<S>", "x<M>y z", "a< b<S c <", "<<P P> <M", "< " * 40, " ", "word"]
    rows = [(i, t) for i in range(40) for t in texts]
    out = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), cut=100)
    got = out.withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.again == r.text for r in got)
    assert all((r.form == "plain") == any(m in r.text for m in fill_in_middle.MARKERS) for r in got)


def test_a_long_text_is_cut_whole(spark):
    text = "lorem ipsum\n" * 500_000
    out = fill_in_middle.fill_in_middle(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string"), cut=100)
    row = out.select("n", F.length("output").alias("size"), fill_in_middle.restored(F.col("output"), F.col("form")).eqNullSafe(F.col("text")).alias("same")).first()
    assert row == (1_000_001, len(text) + 9, True)


def phrases_of(rows, least, longest=4):
    """(f by lang and words, n by lang) of rows (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def brute_collocations(rows, least, top):
    f, n = phrases_of(rows, least)
    out = []
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, w, a, f[lang, w[:k]], f[lang, w[k:]], score))
    longer = defaultdict(int)
    for lang, w, a, *_ in out:
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    kept = defaultdict(list)
    for lang, w, a, l, r, score in out:
        if 100 * longer[lang, w] < 80 * a:
            kept[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in kept.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)}


def test_collocations_by_brute_force(spark):
    rng = random.Random(11)
    words = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "x y", "日本", "the", "of"]
    rows = []
    for i in range(400):
        text = "".join(rng.choices(words, weights=[9, 7, 5, 3, 3, 2, 2, 12, 12])[0] + rng.choice([" ", " ", " ", "\t ", ", ", ".\n", "\x0b", "\r\n"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "de", None, "und"]), 1, 2))
    rows += [(None, None, "en", 1, 2), (1, "", None, 1, 2), (2, " ,.; ", "xx", 1, 2), (3, "one", "yy", 1, 2), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, f long, words int").repartition(5)
    for least, top in ((6, 2000), (30, 12)):
        got = collocations.collocations(docs, least=least, top=top).collect()
        want = brute_collocations([(r[1], r[2]) for r in rows], least, top)
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 20
    phrases, totals = collocations.frequent(docs, least=6)
    f, n = phrases_of([(r[1], r[2]) for r in rows], 6)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.f for r in phrases.collect()} == {k: v for k, v in f.items() if v >= 6}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_saturated_sketch_loses_nothing(spark, monkeypatch):
    """Sixteen cells for thousands of n-grams: everything survives, and the counts stay exact."""
    rng = random.Random(5)
    rows = [(" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(60)), "en") for _ in range(60)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = {tuple(r) for r in collocations.collocations(docs, least=5).collect()}
    assert want == brute_collocations(rows, 5, 2000) and len(want) > 5
    monkeypatch.setattr(collocations, "FEWEST_BITS", 4)
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    monkeypatch.setattr(collocations, "CHUNK", 500)
    assert {tuple(r) for r in collocations.collocations(docs, least=5).collect()} == want


def test_sketch_only_overestimates():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    times = rng.integers(1, 60, len(h))
    sketch = np.zeros((2, 1 << 12), dtype=collocations.counters(30))
    for part in np.array_split(np.repeat(h, times), 7):
        collocations.add_to(sketch, part, 12, 30)
    bitmap = np.stack([np.packbits(row >= 30, bitorder="little") for row in sketch])
    assert collocations.passes(bitmap, h, 12)[times >= 30].all()
    assert collocations.counters(300) == np.uint16
    assert [collocations.width(s) for s in (0, 10**6, 10**15)] == [16, 17, 26]


def brute_links(rows, threshold):
    """{row number: (n_links, component_id)} of rows (vec_id, vector, label)."""
    ok = [i for i, (_, v, label, *_) in enumerate(rows) if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.asarray(rows[i][1], dtype=np.float32).astype(np.float64) for i in ok}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in unit.items()}
    near = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                near[i].add(j)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, stack = {i}, [i]
        while stack:
            new = near[stack.pop()] - group
            group |= new
            stack += new
        seen |= group
        least = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        out.update({j: (len(near[j]), least) for j in group})
    return out


def held(rows, got):
    want = Counter((rows[i][0], *v, rows[i][0] is not None and rows[i][0] == v[1]) for i, v in brute_links(rows, 0.93).items())
    assert Counter(tuple(r) for r in got) == want


def test_embedding_edges(spark, edge_dir):
    got = range_join.op13_embedding_dedup(spark, edge_dir).select("vec_id", "n_links", "component_id", "kept").collect()
    held(vector_rows(), got)
    assert {r.vec_id: r.n_links for r in got}[0] == 6  # copies, multiples and near ones of its label; ids 1, 2, 12, 14, 15 and none


@pytest.mark.parametrize("spread", [0.02, 0.05, 1.0])
def test_range_join_by_brute_force(spark, spread):
    """Clusters, chains and random directions, with pivots for every group, a hot label and many copies."""
    rng = np.random.default_rng(int(spread * 100))
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(700):
        v = centres[rng.integers(12)] + rng.normal(size=8) * spread * 3
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.choice([1, 1, 1, 2, 3]))))
    rows += [(700 + k, rows[5][1], rows[5][2]) for k in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    for cell in (30, 4096):
        held(rows, range_join.near_vectors(frame, cell=cell).collect())


def test_blocks_of_a_large_cell(spark, monkeypatch):
    monkeypatch.setattr(range_join, "BLOCK", 40)
    monkeypatch.setattr(range_join, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    rows = [(i, [float(np.float32(x)) for x in base + rng.normal(size=6) * (0.15 if i % 3 else 2)], 1) for i in range(400)]
    held(rows, range_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())


def test_pruning_keeps_every_pair_within_the_radius():
    rng = np.random.default_rng(9)
    radius = math.sqrt(2 - 2 * 0.93)
    units = rng.normal(size=(900, 3))
    units /= np.linalg.norm(units, axis=1)[:, None]
    pivots = units[:40]
    row, cell, own = range_join.assigned(units, pivots, np.linalg.norm(pivots[:, None] - pivots[None], axis=2), radius)
    assert len(row) < 900 * 12  # of 41 cells a row could be in
    members = defaultdict(set)
    for r, c, o in zip(row.tolist(), cell.tolist(), own.tolist(), strict=True):
        members[c].add((r, o))
    met = Counter(frozenset((a, b)) for m in members.values() for a, x in m for b, y in m if a < b and (x or y))
    near = [frozenset(p) for p in np.argwhere(np.triu(units @ units.T >= 0.93, 1)).tolist()]
    assert near and all(met[p] == 1 for p in near) and max(met.values()) == 1


def test_wrong_threshold(spark):
    with pytest.raises(ValueError):
        range_join.near_vectors(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int"), threshold=-0.5)


@pytest.mark.parametrize("size", [2, 3, 8, 50, 1000])
def test_threshold_never_splits_a_tie(size):
    for toxic, rate, over in (([0] * (size - 1) + [1], 1 / size, False), ([0] + [1] * (size - 1), 1 - 1 / size, size > 2)):
        z = np.zeros(size)
        cut = toxicity.threshold(z, np.array(toxic), rate)
        assert (z >= cut).all() if over else (z < cut).all()
    rng = np.random.default_rng(size)
    z = rng.integers(0, 4, size).astype(float)
    cut = toxicity.threshold(z, rng.integers(0, 2, size), 0.3)
    assert cut not in z


def test_few_labels_leave_the_corpus(spark, edge):
    for labels in ([(3, 0), (9, 1), (12, 0)], [(9, 1), (12, 0)], [(9, 0), (12, 0), (3, 0)]):
        rows = toxicity.drop_toxic(edge, spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == len(edge_rows())
