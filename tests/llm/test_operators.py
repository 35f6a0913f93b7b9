"""Operators against brute force, round trips and held-out accuracy on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from egresslake.llm import brown, exact_dedup, fingerprints, line_dedup, mixing, ngram_join, pii, secrets, sentencepieces, toxicity
from egresslake.llm.queries import QUERIES
from tests.llm.conftest import edge_rows

SPACE = re.compile(r"[\x20\x09-\x0D]")


def texts_of(spark, folder):
    return [(r.doc_id, r.text or "", r.source) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_exact_dedup_edges(spark, edge):
    rows = exact_dedup.exact_dedup(edge, hash_all=True).collect()
    groups = defaultdict(list)
    for r in edge_rows():
        groups[hashlib.sha256(SPACE.sub("", r[1] or "").encode()).hexdigest()].append((-len(r[1] or ""), r[0] is None, r[0]))
    kept = Counter()
    for r in rows:
        g = groups[r.text_sha256]
        assert r.group_size == len(g) and r.keep_id == min(g)[2]
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(rows) == len(edge_rows())


def test_mixing_targets(spark, edge):
    rows = mixing.curriculum_mix(edge).collect()
    by = defaultdict(int)
    for r in edge_rows():
        by[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, free = sum(by.values()), {}, set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * by[s] + 1e-9}
        if not over:
            break
        target |= {s: 3 * by[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == by[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.curriculum_mix(edge).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    where = [r.first_position for r in rows if r.taken]
    assert where == sorted(where) and all(0 <= p <= 1 for p in where)


def test_position_inverts_demand(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("t"))
    for tilt in (-1.0, -0.5, 0.0, 0.7, 1.0):
        share = F.col("t") + tilt * (F.col("t") ** 2 - F.col("t"))
        assert df.select(F.max(F.abs(mixing.position(share, F.lit(tilt)) - F.col("t")))).first()[0] < 1e-6


def brute_secrets(t):
    out = []
    for i, (k, p, ok) in enumerate([
        ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ]):
        out += [(m.start(), i, k, m.end()) for m in re.finditer(p, t) if ok(m)]
    return [f"{k}:{a}:{e}" for a, i, k, e in sorted(out)]


def luhn(s):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d * 2 > 9) for i, d in enumerate(map(int, reversed(s)))) % 10 == 0


def brute_pii(t):
    def dg(m):
        return re.sub("[^0-9]", "", m[0])

    out = []
    for k, p, ok in [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(dg(m)) <= 19 and luhn(dg(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(dg(m)) <= 15),
    ]:
        out += [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m)]
    return out


PARTS = ["password", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEFGHIJKL", "a@b.c", "x@y-z.com.", "+", "(", ")", ".", "-", "1", "42", "255", "256", "4111111111111111",
         "4111 1111-1111 1111", "+1 (555) 123-4567", "@", "_", "é", "😀", "\n", "%", "0001.2.3.4", "1.2.3.4", "deadbeef" * 4, "secret", "gggg", "ghp_" + "a1B2" * 10, "http://u:p@h"]


@pytest.fixture(scope="module")
def mess_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(PARTS, size=int(rng.integers(0, 50))))) for i in range(1500)] + [(5000, None), (5001, "x" * 20_000 + "@" + "1" * 20_000), (None, "password=12345678")]
    d = str(tmp_path_factory.mktemp("mess"))
    spark.createDataFrame([(i, str(t) if t is not None else None, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize(("name", "brute", "kinds"), [("op3_secret_scan", brute_secrets, ["assign", "access", "hex"]), ("op10_pii", brute_pii, ["email", "ip", "card", "phone"])])
def test_spans(spark, mess_dir, name, brute, kinds):
    want = {i: brute(t) for i, t, _ in texts_of(spark, mess_dir)}
    more = 0
    for r in QUERIES[name](spark, mess_dir).collect():
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in kinds] == [sum(s.startswith(k + ":") for s in base) for k in kinds]
        got = r.spans.split(",") if r.spans else []
        assert set(base) <= set(got)
        more += len(got) - len(base)
    assert more > 0


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == ("and", ("abc", "bcd"))
    assert q("[0-9a-f]{32,}") is None
    assert q("ab") is None
    assert set(q("(foo|barn)x*")[1]) == {("and", ("arn", "bar")), "foo"}
    assert q("AKIA[A-Z0-9]{12,}") == ("and", ("aki", "kia"))
    for rule in secrets.RULES:
        for t in secrets.trigrams(q(rule.pattern)):
            assert len(t) == 3 and t == t.lower()


def test_index_misses_nothing(spark, mess_dir):
    """Candidates from postings hold every text that a rule matches."""
    docs = spark.read.parquet(f"{mess_dir}/documents.parquet")
    found = {(r.doc_id, s.kind, s.start, s.end) for r in secrets.scan(docs).collect() for s in r.spans}
    full = set()
    for rank, rule in enumerate(secrets.RULES):
        for r in docs.select("doc_id", secrets.found_by(rule, rank, F.coalesce("text", F.lit(""))).alias("s")).collect():
            full |= {(r.doc_id, s.kind, s.start, s.end) for s in r.s}
    assert found == full


def test_fingerprints(spark, edge_dir, sf):
    for d in (edge_dir, sf):
        rows = texts_of(spark, d)
        if d == sf:
            order = sorted(rows, reverse=True)
            want = {}
            for i, (doc, t, _) in enumerate(order):
                k, nxt = len(t) // 3, order[(i + 1) % len(order)][1]
                want[doc] = hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        got = QUERIES["op4_fingerprints"](spark, d).collect()
        assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        if d == sf:
            assert {r.doc_id: r.edited_sha256 for r in got} == want
            assert np.mean([r.near_edited for r in got if r.n_chars > 200]) > 0.6
            assert np.mean([r.near_next for r in got if r.n_chars > 200]) < 0.1


def test_sketch_estimates_containment_and_merges(spark):
    words = [f"w{i}" for i in range(4000)]
    small, large = " ".join(words[:400]), " ".join(words)
    a, b = F.lit(small), F.lit(large)
    row = spark.range(1).select(
        fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)).alias("in_large"), fingerprints.likeness(fingerprints.sketch(b), fingerprints.sketch(a)).alias("in_small"),
        fingerprints.sketch(F.concat(a, F.lit(" "), b)).alias("whole"), fingerprints.merged(fingerprints.sketch(a), fingerprints.sketch(b)).alias("parts"),
    ).first()
    assert row.in_large == 1.0 and 0.05 < row.in_small < 0.16
    assert set(row.parts) <= set(row.whole) and len(row.whole) - len(row.parts) <= 4


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join_against_all_pairs(spark, sf, edge_dir):
    for d in (sf, edge_dir):
        rows = texts_of(spark, d)
        sets = defaultdict(list)
        for doc, t, _ in rows:
            sets[shingle_set(t)].append(doc)
        keys = list(sets)
        links, parent = Counter(), list(range(len(keys)))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(keys):
            for j in range(i):
                b = keys[j]
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
        groups = defaultdict(list)
        for i, k in enumerate(keys):
            groups[find(i)] += sets[k]
        want = sorted((str(doc), links[i], str(min((x is None, x) for x in groups[find(i)])[1])) for i, k in enumerate(keys) for doc in sets[k])
        got = sorted((str(r.doc_id), r.n_links, str(r.class_id)) for r in QUERIES["op5_ngram_join"](spark, d).collect())
        assert got == want


def test_ngram_join_large_near_group(spark):
    base = [f"tok{i}" for i in range(120)]
    rows = [(i, " ".join([*base[: i % 60], f"edit{i}", *base[i % 60 :]])) for i in range(700)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and sum(r.kept for r in got) == 1
    sets = [shingle_set(t) for _, t in rows[:700]]
    for i in (0, 5, 699):
        assert next(r.n_links for r in got if r.doc_id == i) == sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for s in sets) - 1


def test_brown_scores(spark, edge_dir, sf):
    for d in (edge_dir, sf):
        rows = texts_of(spark, d)
        fold = {doc: zlib.crc32(("" if doc is None else str(doc)).encode()) % 5 for doc, *_ in rows}
        c = Counter(w for doc, t, _ in rows if fold[doc] != 1 for w in [*t.encode().lower().split(), None])
        n, v = sum(c.values()), len(c)
        want = sorted((str(doc), round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4), len(ws), sum(c[w] > 0 for w in ws), fold[doc] == 1, n) for doc, t, _ in rows for ws in [[*t.encode().lower().split(), None]])
        out = QUERIES["op6_brown_scores"](spark, d).collect()
        got = sorted((str(r.doc_id), round(r.base_score, 4), r.n_tokens, r.n_known, r.held_out, r.train_tokens) for r in out)
        assert [g[0::2] for g in got] == [w[0::2] for w in want]
        assert all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, want, strict=True))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_groups_alike_words():
    pairs = np.zeros((8, 8))
    for a in (0, 1, 2):
        for b in (3, 4, 5):
            pairs[a, b] = pairs[b, a] = 20
    pairs[6, 7] = pairs[7, 6] = 5
    cls = brown.exchange(pairs, 6, classes=2)
    assert len(set(cls[:3])) == 1 and len(set(cls[3:6])) == 1 and cls[0] != cls[3]


def test_sentencepiece_parity(spark, edge_dir, sf):
    data = sentencepieces.read_model()
    sp = sentencepieces.original(data)
    for d in (edge_dir, sf):
        docs = spark.read.parquet(f"{d}/documents.parquet")
        rows = sentencepieces.encode(docs, data, parity_every=1, also=["text"]).collect()
        assert all(r.parity for r in rows) and all(r.round_trip for r in rows)
        assert all(list(r.token_ids) == sp.encode(r.text or "") for r in rows)
        whole, text_of = sentencepieces.loaded(data), sentencepieces.speller(data)
        assert all(whole.decode(list(r.token_ids)) == text_of(list(r.token_ids)) == (r.text or "") for r in rows)
    back = sentencepieces.decode(sentencepieces.encode(docs, data, also=["text"]), data).collect()
    assert all(r.decoded == r.text for r in back)
    for text in ("<s>hi</s> <0x0A>", "  a  b ", "\n\n", "😀 ź", "x\x00y", "a" * 3000):
        assert list(sentencepieces.encode_all(sentencepieces.loaded(data), [text])) == [sp.encode(text)]


def test_unigram_model_is_rebuilt():
    import struct

    def field(n, wire, body):
        return bytes([n << 3 | wire]) + body

    def piece(s, score, kind):
        body = field(1, 2, bytes([len(s.encode())]) + s.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    trainer, rules = field(3, 0, b"\x01"), field(3, 0, b"\x01") + field(4, 0, b"\x01")
    data = b"".join([piece("<unk>", 0, 2), piece("▁ab", -1.0, 1), piece("▁", -3.0, 1), piece("a", -2.0, 1), piece("b", -2.5, 1), piece("c", -2.0, 1)]) + field(2, 2, bytes([len(trainer)]) + trainer) + field(3, 2, bytes([len(rules)]) + rules)
    t = sentencepieces.Model(data).tokenizer()
    assert t.encode("ab  abc").tokens == ["▁ab", "▁ab", "c"]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in QUERIES["op9_toxicity"](spark, d).collect() if r.held_out and r.doc_id in labels]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.85


def test_toxicity_features():
    assert len(toxicity.features(None)) == 0 and len(toxicity.features("")) == 0
    a, long = toxicity.features("Hello  World"), "word " * 9000
    assert np.array_equal(a, toxicity.features("hello world"))
    assert len(set(toxicity.features(long))) == len(toxicity.features(long)) < 40


def test_simhash_is_the_majority_of_bits():
    from egresslake.llm.shingles import _majority, line_parts

    rng = np.random.default_rng(1)
    h = rng.integers(0, 256, size=(1000, 8), dtype=np.uint8)
    starts, counts = np.array([0, 1, 20, 700]), np.array([1, 19, 680, 300])
    got = _majority(h, starts, counts)
    for g, s, n in zip(got, starts, counts, strict=True):
        bits = np.unpackbits(h[s : s + n], axis=1).sum(axis=0)
        assert np.array_equal(np.unpackbits(np.array([g]).view(np.uint8)), (2 * bits > n).astype(np.uint8))
    line, node, sim, *_ = line_parts("A b c d e\n\nx\na  B c d e\nf g h i j k", 5)
    assert line.tolist() == [0, 3, 4] and node[0] == node[1] != node[2] and sim[0] == sim[1]


def test_line_dedup(spark):
    rng = np.random.default_rng(5)
    lines = [" ".join(f"w{rng.integers(0, 500)}" for _ in range(40)) for _ in range(60)]
    near = [line.rsplit(" ", 1)[0] + " changed" for line in lines[:20]]
    docs = [(i, "\n".join([lines[i], lines[(i * 7) % 60], "short line", near[i % 20], ""]), "en", "s") for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    for least, short in ((5, 60), (1, 1)):
        got = line_dedup.drop_lines(df, least_words=least).orderBy("doc_id").collect()
        left = [line for r in got for line in r.text.split("\n")]
        counts = Counter(left)
        assert counts["short line"] == short and counts[""] == 60
        assert all(counts[line] <= 1 for line in lines + near)
        assert sum(counts[line] + (counts[near[i]] if i < 20 else 0) for i, line in enumerate(lines)) == 60
        assert all(r._lines == 5 for r in got) and sum(r._dropped for r in got) == 60 * 3 - 60 + 60 - short
        assert got[0].text.split("\n")[0] == lines[0]


@pytest.mark.parametrize(("a", "b"), [("kitten", "sitting"), ("", "abc"), ("abc", "abc"), ("abcdef", "azced"), ("a" * 300, "a" * 150 + "b" + "a" * 149), ("héllo wörld", "hello world")])
def test_edit_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        d, old = [i], d
        for j, y in enumerate(b, 1):
            d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
    for most in range(0, d[-1] + 3):
        assert line_dedup.within(a, b, most) == (d[-1] <= most)


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, pii.CELLS, 3000))
    x = pii.unpacked(cells)
    yes = np.where((x[:, 2] == 1) & (x[:, 1] >= 3), 10.0, 0.0)
    start, trees = pii.boosted(x, yes, 10.0 - yes)
    z = start + sum(t.on(x) for t in trees)
    assert ((z > 0) == (yes > 0)).mean() > 0.99
    cuts = pii.calibrated(z, yes, 10.0 - yes, x[:, 0])
    assert all(np.isfinite(cuts))
