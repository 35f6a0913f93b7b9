"""Class scores, fingerprint likeness and the pipeline's stages, each against what it should give by a plainer way."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from egresslake.llm import brown, fingerprints, sentencepieces
from egresslake.llm.queries import QUERIES
from egresslake.llm.shingles import hashed_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_brown_scores_are_products_over_tokens(spark, sf):
    """The score of each text from counts and the learned classes, by the formula and token by token."""
    docs = spark.createDataFrame(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(80).collect(), "doc_id long, text string").repartition(3)
    texts = {r.doc_id: [*hashed_words((r.text or "").encode().lower())[0].view(np.int64).tolist(), brown.END] for r in docs.collect()}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    model = brown.learn(spark.createDataFrame([(t,) for t in train], "h array<long>").repartition(2))
    counts = Counter(w for t in train for w in t)
    cls = dict(zip(model.head.tolist(), model.head_class.tolist(), strict=True)) | {r.h: r.cls for r in model.vocabulary.collect()}
    assert set(cls) == set(counts)
    k = model.classes  # the end's class; k + 1 stands for unknown words
    moves, after = defaultdict(float), defaultdict(float)
    for t in train:
        for a, b in zip([brown.END, *t], t, strict=False):
            moves[cls[a], cls[b]] += 1
    sizes = defaultdict(float)
    for (a, b), n in moves.items():
        after[a] += n
        sizes[b] += n
    share = {c: (sizes[c] + 0.5) / sum(sizes[x] + 0.5 for x in range(k + 1)) for c in range(k + 1)}
    mass = defaultdict(float)
    for w, c in counts.items():
        mass[cls[w]] += c + 0.5
    total = sum(counts.values())
    everything = total + 0.5 * (len(counts) + 1)
    got = {r.doc_id: r for r in brown.score(docs).collect()}
    for i, t in texts.items():
        base = score = 0.0
        before = k
        for w in t:
            c = counts[w]
            base += np.log10((c + 0.5) / everything)
            if c:
                move = share[cls[w]] if before == k + 1 else (moves[before, cls[w]] + brown.SMOOTH * share[cls[w]]) / (after[before] + brown.SMOOTH)
                score += np.log10((1 - 0.5 / everything) * (c + 0.5) * (brown.MIX * move / mass[cls[w]] + (1 - brown.MIX) / (everything - 0.5)))
            else:
                score += np.log10(0.5 / everything)
            before = cls[w] if c else k + 1
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(score, rel=1e-6), i
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_likeness_against_whole_shingle_sets(spark, sf):
    """Exact where sketches hold all shingles; else within the spread of a sample of a quarter of them."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    order = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, sf).collect()}
    exact, errors = 0, []
    for at, (i, text) in enumerate(order):
        follower = order[(at + 1) % len(order)][1]
        cut = len(text) - len(text) // 3
        mine = shingles(text)
        for name, other in (("near_edited", text[:cut] + follower[: len(text) // 3]), ("near_next", follower)):
            theirs = shingles(other)
            want = (len(mine & theirs) / len(mine) if mine else 0.0) if mine or theirs else 1.0
            if len(mine) < fingerprints.FLOOR and len(theirs) < fingerprints.FLOOR:
                exact += 1
                assert got[i][name] == pytest.approx(want), (i, name)
            else:
                seen = max(1.0, 0.25 * len(mine))
                errors.append((got[i][name] - want) / max(0.05, (want * (1 - want) / seen) ** 0.5))
    assert exact > 5 and np.mean(np.abs(errors)) < 1.2 and np.max(np.abs(errors)) < 6


def near_groups(rows):
    """Least row of each group of texts whose word 5-gram sets are similar by 0.8 or more, directly or through others."""
    sets = [shingles(r.text or "") for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = sets[i] == sets[j] or (both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8)
            if same and find(i) != find(j):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r.doc_id)
    return {min(g) for g in groups.values()}


def test_pipeline_stage_by_stage(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    kept = stages["toxicity"](spark, docs, sf).cache()
    assert {r.doc_id for r in kept.collect()} == {i for i, s in scores.items() if s < 0.5} and kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = [bool(labels[i]) for i in labels if i in scores]
    assert np.mean([(scores[i] >= 0.5) == bool(t) for i, t in labels.items() if i in scores]) >= max(np.mean(toxic), 1 - np.mean(toxic))

    once = stages["exact_dedup"](spark, kept, sf).cache()
    groups = defaultdict(list)
    for r in kept.collect():
        groups["".join(WORD.findall(r.text or ""))].append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in once.collect()} == {min(g)[1] for g in groups.values()}

    apart = stages["ngram_join"](spark, once, sf).cache()
    assert {r.doc_id for r in apart.collect()} == near_groups(once.collect())

    mix = stages["curriculum_mix"](spark, apart, sf).cache()
    times = Counter(r.doc_id for r in mix.collect())
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in apart.collect()}
    source = {r.doc_id: r.source for r in apart.collect()}
    assert set(times) <= {i for i, n in size.items() if n} and max(times.values()) <= 3
    whole, taken = defaultdict(int), defaultdict(int)
    for i, n in size.items():
        whole[source[i]] += n
        taken[source[i]] += n * times[i]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(whole, key=lambda s: (s is None, s or "")))}
    target, left, open_ = {}, sum(whole.values()), dict(weight)
    while open_:
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * level > 3 * whole[s]]
        for s in full or list(open_):
            target[s] = 3 * whole[s] if full else open_[s] * level
            left -= target[s]
            del open_[s]
    for s in whole:
        most = max(n for i, n in size.items() if source[i] == s)
        assert abs(taken[s] - target[s]) <= most + 1, s

    data = sentencepieces.read_model()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    text = {r.doc_id: r.text or "" for r in apart.collect()}
    for r in stages["sentencepiece"](spark, mix, sf).collect():
        assert list(r.token_ids) == sp.encode(text[r.doc_id]) and r.parity and r.n_tokens == len(r.token_ids)


def test_very_long_texts(spark, tmp_path):
    """A text of five megabytes among short ones, through every operator that reads documents."""
    rng = np.random.default_rng(3)
    words = np.array(["".join(chr(97 + i // 20**k % 20) for k in range(4)) + "z" for i in range(3000)])  # no digits: see README on operators 3 and 10
    long = " ".join(words[rng.integers(0, 3000, 640_000)]) + " mail me a@b.example now"
    rows = [(i, " ".join(words[rng.integers(0, 3000, 30)]), "en", f"s{i % 3}", 1) for i in range(30)] + [(30, long, "en", "s0", len(long)), (31, long[:-1], "en", "s1", len(long))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_curriculum_mix", "op3_secret_scan", "op4_fingerprints", "op5_ngram_join", "op6_brown_scores", "op7_sentencepiece", "op8_exact_dedup", "op9_toxicity", "op10_pii", "op11_fill_in_middle"):
        rows = {r.doc_id: r for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert len(rows) == 32, name
    assert rows[30].n == 640_004 and QUERIES["op10_pii"](spark, str(tmp_path)).filter(F.col("doc_id") == 30).first().n_email == 1
    assert {r.class_id for r in QUERIES["op5_ngram_join"](spark, str(tmp_path)).filter("doc_id >= 30").collect()} == {30}
    assert {r.lang for r in QUERIES["op12_collocations"](spark, str(tmp_path)).collect()} <= {"en"}
