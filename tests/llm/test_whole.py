"""Cases in which operators once did less than the whole job."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from egresslake.llm import brown, fingerprints, line_dedup, toxicity
from egresslake.llm.queries import QUERIES
from egresslake.llm.shingles import hashed_words, line_parts
from tests.llm.test_operators import brute_pii


def test_octets_of_zeros_are_addresses(spark, tmp_path):
    rng = np.random.default_rng(11)
    texts = ["10.0.0.1", "127.0.0.1", "at 192.168.0.1.", "0.0.0.0", "00.000.0.00", "000256.0.0.1", "0.0.0.256", "0" * 20_000 + ".0.0.1", "0" * 20_000 + "256.0.0.1"]
    texts += ["".join(rng.choice(["0", "00", "10.0.0.1", ".", ".", ".", "1", "255", "256", " "], size=12)) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op10_pii"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_ip for r in got if r.doc_id < 9} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1, 8: 0}
    for r in got:
        if len(texts[r.doc_id]) > 4000:  # more digits than int() reads
            continue
        assert r.base_sha256 == hashlib.sha256(",".join(brute_pii(texts[r.doc_id])).encode()).hexdigest()


def test_sketch_of_a_repetitive_text_keeps_the_least_hashes(spark):
    words = [f"w{i}" for i in range(30)]
    once, often = " ".join([*words, *words[:4]]), " ".join(words * 100)
    shingles = [tuple((words * 2)[i : i + 5]) for i in range(30)]
    hashed = spark.createDataFrame(shingles, "a string, b string, c string, d string, e string").select(F.shiftright(F.xxhash64("a", "b", "c", "d", "e"), 32).cast("int").alias("h"))
    hashes = sorted(r.h for r in hashed.collect())
    want = [h for i, h in enumerate(hashes) if h < fingerprints.limit(fingerprints.FRACTION) or i < fingerprints.FLOOR]
    other = " ".join(f"v{i}" for i in range(400))
    a, b, c = (fingerprints.sketch(F.lit(t)) for t in (once, often, other))
    row = spark.range(1).select(a.alias("once"), b.alias("often"), fingerprints.likeness(b, a).alias("like"), fingerprints.merged(b, c).alias("parts"), fingerprints.merged(a, c).alias("same")).first()
    assert row.once == want and row.often == want and len(want) >= fingerprints.FLOOR
    assert row.like == 1.0 and row.parts == row.same


def test_every_document_is_checked_for_parity(spark, edge, edge_dir):
    assert {r.parity for r in QUERIES["op7_sentencepiece"](spark, edge_dir).collect()} == {True}
    stage = dict(corpus_pipeline.STAGES)["sentencepiece"]
    assert {r.parity for r in stage(spark, edge, edge_dir).collect()} == {True}


def recall(words, replaced, edit, n=200):
    """Share of the pairs (a line of so many words, a similar copy with so many words edited) that become candidates."""
    rng = np.random.default_rng(words)

    def word():
        return f"{'abcdefghij'[rng.integers(10)]}{rng.integers(0, 10**6)}"

    found = similar = 0
    for _ in range(n):
        line = [word() for _ in range(words)]
        other = list(line)
        for i in rng.choice(words, size=replaced, replace=False):
            other[i] = word() if edit == "word" else other[i][:-1] + "x"
        a, b = " ".join(line), " ".join(other)
        if line_dedup.similar(a, b):
            similar += 1
            _, _, sim, few, size, keys, m = line_parts(f"{a}\n{b}")
            pairs = [line_dedup.word_pairs(x) for x in (a, b)]
            enough = few.any() or len(pairs[0] & pairs[1]) >= line_dedup.LEAST_PAIRS * max(map(len, pairs))
            found += bool(enough and set(keys[: m[0]].tolist()) & set(keys[m[0] :].tolist()) and line_dedup.close(*({"sim": sim[[k]], "few": few[[k]], "size": size[[k]]} for k in (0, 1)))[0])
    return found / similar if similar else 1.0


def test_line_candidates_by_length():
    """At similarities down to 0.8, at least nine of ten similar pairs become candidates, whatever the length."""
    edits = [(3, 1), (5, 1), (9, 1), (10, 1), (10, 2), (20, 1), (20, 2), (20, 4), (40, 1), (40, 4), (40, 8), (80, 1), (80, 16)]
    got = {(words, k, edit): recall(words, k, edit) for words, k in edits for edit in ("word", "letter")}
    print(got)
    assert min(got.values()) >= 0.95


def test_lines_against_all_pairs(spark):
    """Groups of lines are those of a comparison of all pairs of lines."""
    rng = np.random.default_rng(8)
    vocabulary = [f"{'abcdefgh'[i % 8]}{i * 37 % 1000}" for i in range(300)]
    lines = []
    for words in (1, 2, 3, 4, 6, 8, 9, 12, 19, 20, 22, 25, 40, 80):
        for _ in range(6):
            line = list(rng.choice(vocabulary, size=words))
            lines.append(" ".join(line))
            for _ in range(3):
                kind, i = rng.integers(4), int(rng.integers(len(line)))
                if kind == 0:
                    line[i] = str(rng.choice(vocabulary))
                elif kind == 1:
                    line[i] += "x"
                elif kind == 2:
                    line.insert(i, "new")
                elif len(line) > 1:
                    del line[i]
                lines.append(" ".join(line))
    lines += ["在城市中心的大型体育场馆发生紧急情况时所有人员应当按照指示牌", "在城市中心的大型体育场馆发生紧急情况时全部人员应当按照指示牌", "完全不同的一行文字没有任何相同之处"]
    lines = list(dict.fromkeys(lines))
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            if line_dedup.similar(a, lines[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i for i in range(len(lines)) if find(i) == i}
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "doc_id long, text string").repartition(3)
    got = {r.doc_id for r in line_dedup.drop_lines(docs).collect() if r.text}
    assert want <= got and len(got - want) <= 0.02 * len(lines)


def test_rows_with_one_id_lose_their_own_lines(spark):
    rows = [(1, "same words here and there\nfirst"), (1, "same words here and there\nsecond"), (None, "same words here and there\nthird")]
    got = sorted(r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(got) == 3 and sum("same words" in t for t in got) == 1 and {t.split("\n")[-1] for t in got} == {"first", "second", "third"}


def test_near_lines_are_found_within_a_tight_bound(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{rng.integers(0, 500)}" for _ in range(40)) for _ in range(60)]
    near = [line.rsplit(" ", 1)[0] + " changed" for line in lines[:20]]
    docs = [(i, "\n".join([lines[i], lines[(i * 7) % 60], near[i % 20]])) for i in range(60)]
    left = [x for r in line_dedup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect() for x in r.text.split("\n") if x]
    assert len(left) == 60


def test_similar_is_edit_similarity():
    rng = np.random.default_rng(2)
    lines = [" ".join(rng.choice(["ab", "abc", "é", "日本", "x", "word"], size=int(rng.integers(3, 9)))) for _ in range(120)]

    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
        return d[-1]

    for a in lines[:60]:
        for b in lines[60:]:
            d = distance(a, b)
            assert line_dedup.similar(a, b) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)
            assert sum(max(len(x), len(y)) for x, y in line_dedup.gaps(a.split(" "), b.split(" "))) >= d
            assert line_dedup.distance(a, b, 99) == d and line_dedup.distance(a, b, d - 1) is None


def test_short_lines_take_part_in_the_query(spark, tmp_path):
    chinese = "在城市中心的大型体育场馆发生紧急情况时所有人员应当按照指示牌迅速有序地撤离到安全区域并等待进一步的通知"
    lines = ["Read more", "x", chinese, ""]
    rows = [(i, "\n".join([*lines, f"{i * 7919 + 10**6}"])) for i in range(3)] + [(3, chinese + "\n  READ   more ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in QUERIES["op2_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {0: (5, 0), 1: (5, 3), 2: (5, 3), 3: (2, 2)}


def test_class_scores_by_brute_force(spark, sf):
    """Every training word has a class, no other class adds more likelihood, and scores are products over tokens."""
    docs = spark.createDataFrame(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect(), "doc_id long, text string")
    texts = {r.doc_id: [*hashed_words((r.text or "").encode().lower())[0].view(np.int64).tolist(), brown.END] for r in docs.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    train = [t for i, t in texts.items() if not fold[i]]
    counts = Counter(w for t in train for w in t)
    tokens = spark.createDataFrame([(t,) for t in train], "h array<long>").repartition(3)
    model = brown.learn(tokens, clustered=40, classes=5)
    likelihoods = [x for _, x in model.report]
    assert likelihoods == sorted(likelihoods) and model.report[-1][0] == 0
    rows = {r.h: (r.c, r.cls) for r in model.vocabulary.collect()}
    first = sorted((w for w in counts if w != brown.END), key=lambda w: (-counts[w], w))[:40]
    head = dict(zip(model.head.tolist(), model.head_class.tolist(), strict=True))
    assert set(rows) == set(counts) - set(first) - {brown.END} and all(c == counts[w] for w, (c, _) in rows.items())
    cls = {w: head[w] for w in [*first, brown.END]} | {w: c for w, (_, c) in rows.items()}
    k = model.classes
    for c in range(k + 1):
        assert np.isclose(model.mass[c], sum(counts[w] + 0.5 for w in counts if cls[w] == c))
    # Placement: the clustered words' class counts with one more word, by class.
    rest = k + 1
    base, context = np.zeros((k + 2, k + 2)), defaultdict(Counter)
    unit = {w: cls[w] if w in first or w == brown.END else rest for w in counts}
    for t in train:
        for a, b in zip([brown.END, *t], t, strict=False):
            base[unit[a], unit[b]] += 1
            context[b][0, unit[a]] += 1
            context[a][1, unit[b]] += 1
    for w in sorted(rows)[::37]:
        gains = []
        for c in range(k):
            gain = 0.0
            for (side, u), n in context[w].items():
                at = base[u, c] if side == 0 else base[c, u]
                gain += brown._nlogn(at + n) - brown._nlogn(at)
            sums = base[:, c].sum(), base[c, :].sum()
            gains.append(gain - sum(brown._nlogn(s + counts[w]) - brown._nlogn(s) for s in sums))
        assert gains[rows[w][1]] >= max(gains) - 1e-3
    # Scores.
    count = np.zeros((k + 2, k + 2))
    for t in train:
        for a, b in zip([brown.END, *t], t, strict=False):
            count[cls[a], cls[b]] += 1
    part = brown.token_logs(count, model)
    got = {r.doc_id: r for r in brown.score(docs).collect()}
    blocks = brown.classed(spark.createDataFrame([(i, fold[i], t) for i, t in texts.items()], "id long, held_out boolean, h array<long>"), model)
    assert np.array_equal(brown.transitions(blocks, k), count)
    for b in blocks.collect():
        before, c = brown._steps(b.cls, k)
        at = 0
        for i, n, known, logs in zip(b.ids, b.n, b.known, b.logs, strict=True):
            t = texts[i]
            assert n == len(t) and known == sum(counts[w] > 0 for w in t)
            seq = [cls.get(w, k + 1) for w in t]
            assert c[at : at + n].tolist() == seq and before[at : at + n].tolist() == [k, *seq[:-1]]
            assert np.isclose(logs, sum(np.log10(counts[w] + 0.5) for w in t))
            at += n
    # Each row of probabilities adds up to one over the vocabulary and the unknown word.
    known = 10.0 ** part[:, : k + 1] @ np.array([sum(counts[w] + 0.5 for w in counts if cls[w] == c) for c in range(k + 1)])
    assert np.allclose(known + 0.5 / model.everything, 1.0)
    assert set(got) == set(texts)


def brute_features(text):
    raw = f" {' '.join(text.lower().split())} ".encode() if text else b""
    out = set()
    for n in toxicity.NGRAMS:
        for i in range(len(raw) - n + 1):
            h = raw[i] * 0x01000193 & 0xFFFFFFFF
            for c in raw[i + 1 : i + n]:
                h = (h ^ c) * 0x01000193 & 0xFFFFFFFF
            h ^= h >> 15
            out.add(((h * 0x9E3779B1 & 0xFFFFFFFF) + n & 0xFFFFFFFF) >> 32 - toxicity.BITS)
    return out


def test_toxicity_scores_by_brute_force(spark, edge, edge_dir):
    """Scores are a sigmoid of the summed weights of a text's n-grams; an id that repeats trains once."""
    labels = spark.createDataFrame([(i * 3, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    model = toxicity.train(edge, labels)
    again = toxicity.train(edge.unionByName(edge.filter("doc_id = 15")).unionByName(edge.filter("doc_id = 15")), labels)
    assert np.array_equal(model[0], again[0]) and model[1] == again[1]
    for r in edge.select("text", toxicity.scored(F.col("text"), model).alias("s")).collect():
        z = float(model[0][sorted(brute_features(r.text))].sum(dtype=np.float64)) + model[1]
        assert np.isclose(r.s, 1 / (1 + np.exp(-z)), atol=1e-9)
