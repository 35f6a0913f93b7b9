r"""Operator 6: language-model scores by Brown's class-based bigrams.

Tokens are the words of a text in ASCII lower case and one end. Training texts are those whose
crc32(id as text) mod 5 is not 1; all of them are counted.

Every training word gets a class by exchange clustering, in two steps, as in Brown's algorithm with a window of
frequent words. The CLUSTERED most frequent words are exchanged between CLASSES classes on the driver (each word in turn
moves to the class with the best likelihood of the class bigrams, until no word moves or for SWEEPS
sweeps; `Model.report` has words moved and likelihood after each). Then all other words are placed where they lie, in
Spark: a word's counts of classes before and after it are summed over the corpus, and it goes to the class to
which it adds the most likelihood by the same formula. The end has a class of its own.

A known token's probability is, with c(w) its count, D(class) the sum of c + 0.5 over the class, D that sum
over all tokens and 0.5 for an unknown word, and transitions smoothed by class frequency,

    (1 - 0.5 / D) (c(w) + 0.5) (MIX P(class | class before) / D(class) + (1 - MIX) / (D - 0.5))

An unknown word's is 0.5 / D, and the class after one has its share of all tokens. These add up to one.

Texts are hashed once into stored tables of numbers. Workers hold counts and classes of the most frequent words, at most HEAD; those of
the others are joined to the distinct words of blocks of texts in a shuffle, no key of which is frequent. The
vocabulary is never on the driver; counts of the CLUSTERED words' pairs are, (CLUSTERED + 2) squared at most, and class counts.

Defined results: a null text counts as empty and consists of its end; null ids count as the empty text
for the fold; rows that repeat are scored alike; without training texts every count is zero; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import fold, release, small_batches, stored
from egresslake.llm.shingles import hashed_words

CLUSTERED = 1000
CLASSES = 32
SWEEPS = 30
HEAD = 1 << 18
MIX = 0.9
SMOOTH = 1.0
#: The end token's hash.
END = 0x5EED0000000000E0
#: Tokens counted in a worker before partial counts go on.
HELD = 4_000_000
#: Class numbers of a block's tokens fit in a byte: one for words to be joined, one for unknown words.
LATER, UNKNOWN = 255, 254
_CODE = 8  # bits of a class number


def token_rows(docs: DataFrame) -> DataFrame:
    """(id, held_out, h): the token hashes of each row of docs (id, held_out, txt), the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.append(hashed_words((t or "").encode("utf-8", "surrogatepass").lower())[0].view(np.int64), END) for t in batch.column("txt").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
            values = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "held_out", "h"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "held_out", "txt").mapInArrow(run, f"id {kind}, held_out boolean, h array<long>")


def _flat(batch: pa.RecordBatch, column: str = "h") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def token_counts(train: DataFrame) -> DataFrame:
    """(h, c) of all training tokens."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in batches:
            held.append(_flat(batch))
            if sum(map(len, held)) > HELD:
                yield flush()
        if held:
            yield flush()

    return train.select("h").mapInArrow(partial, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def numbered(h: np.ndarray, words: np.ndarray, number: np.ndarray, rest: int, end: int) -> np.ndarray:
    """Each token's number: that of its word among the sorted `words`, `end` for the end, `rest` for all others."""
    out = np.where(h == END, end, rest)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        out = np.where(words[at] == h, number[at], out)
    return out


def bigrams(train: DataFrame, top: np.ndarray) -> np.ndarray:
    """Counts of pairs of units: the clustered words (by rank), all other words, and the end, which also stands before a text."""
    order = np.argsort(top, kind="stable")
    words, size = top[order], len(top) + 2

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            u = numbered(_flat(batch), words, order, size - 2, size - 1)
            if len(u):
                total += np.bincount(np.concatenate([[size - 1], u[:-1]]) * size + u, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "c"])

    return _matrix(train.select("h").mapInArrow(partial, "pair long, c long"), size, size)


def _matrix(cells: DataFrame, height: int, width: int) -> np.ndarray:
    """The sums of cells (pair, c) as a matrix on the driver."""
    out = np.zeros(height * width)
    got = cells.groupBy("pair").agg(F.sum("c").alias("c")).toPandas()
    out[got["pair"].to_numpy(dtype=np.int64)] = got["c"].to_numpy()
    return out.reshape(height, width)


def _nlogn(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(count: np.ndarray) -> float:
    """What class bigram counts add to the log likelihood; the words' own frequencies add a constant."""
    return float(_nlogn(count).sum() - _nlogn(count.sum(axis=0)).sum() - _nlogn(count.sum(axis=1)).sum())


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS, report: list | None = None) -> np.ndarray:
    """Class of each unit: the first `words` units are clustered into `classes`, the others keep one class each."""
    n = len(pairs)
    k = min(classes, max(1, words))
    total = k + n - words
    cls = np.concatenate([np.arange(words) % k, np.arange(k, total)]).astype(np.int64)
    member = np.eye(total)[cls]
    left, right = pairs @ member, pairs.T @ member  # counts of a unit before and after each class
    count = member.T @ left
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            old, self_pairs = cls[w], pairs[w, w]
            out_w, in_w = left[w].copy(), right[w].copy()
            out_w[old] -= self_pairs
            in_w[old] -= self_pairs
            count[old, :] -= out_w
            count[:, old] -= in_w
            count[old, old] -= self_pairs
            sums_out, sums_in = count.sum(axis=1), count.sum(axis=0)
            tot_out, tot_in = out_w.sum() + self_pairs, in_w.sum() + self_pairs
            rows = (_nlogn(count[:k] + out_w) - _nlogn(count[:k])).sum(axis=1)
            cols = (_nlogn(count[:, :k] + in_w[:, None]) - _nlogn(count[:, :k])).sum(axis=0)
            diag = np.arange(k)
            was = count[diag, diag]
            both = _nlogn(was + out_w[:k] + in_w[:k] + self_pairs) - _nlogn(was)
            single = (_nlogn(was + out_w[:k]) - _nlogn(was)) + (_nlogn(was + in_w[:k]) - _nlogn(was))
            gain = rows + cols - single + both
            row_sum, col_sum = sums_out[:k] + in_w[:k], sums_in[:k] + out_w[:k]
            gain -= _nlogn(row_sum + tot_out) - _nlogn(row_sum) + _nlogn(col_sum + tot_in) - _nlogn(col_sum)
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = old
            count[new, :] += out_w
            count[:, new] += in_w
            count[new, new] += self_pairs
            if new != old:
                moved += 1
                cls[w] = new
                left[:, old] -= pairs[:, w]
                left[:, new] += pairs[:, w]
                right[:, old] -= pairs[w, :]
                right[:, new] += pairs[w, :]
        if report is not None:
            report.append((moved, likelihood(count)))
        if not moved:
            break
    return cls


def contexts(train: DataFrame, words: np.ndarray, cls: np.ndarray, k: int) -> DataFrame:
    """(h, seen): for each word that is not clustered, count << 9 | side << 8 | class of the tokens before and after it, per part of the corpus."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[np.ndarray] = []
        codes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, at = np.unique(np.concatenate(hs), return_inverse=True)
            key, c = np.unique(np.concatenate([at << 9 | code for at, code in zip(np.split(np.tile(at, 2), 2), np.concatenate(codes, axis=1), strict=True)]), return_counts=True)
            offsets = np.searchsorted(key >> 9, np.arange(len(u) + 1)).astype(np.int32)
            hs.clear()
            codes.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c.astype(np.int64) << 9 | key & 511))], names=["h", "seen"])

        for batch in batches:
            h = _flat(batch)
            code = numbered(h, words, cls, k, k + 1)
            tail = np.flatnonzero(code == k)  # an end follows each of them
            before = np.where(tail > 0, code[tail - 1], k + 1)
            hs.append(h[tail])
            codes.append(np.stack([before, code[tail + 1 if len(tail) else tail] | 256]))
            if sum(map(len, hs)) > HELD // 2:
                yield flush()
        if sum(map(len, hs)):
            yield flush()

    return train.select("h").mapInArrow(partial, "h long, seen array<long>")


def placed(seen: DataFrame, count: np.ndarray, k: int) -> DataFrame:
    """(h, c, cls): the count and class of each word by its summed contexts, given the class counts of the clustered words."""
    size = count.shape[0]
    near = np.zeros((512, k))  # counts of (class, candidate) by code
    near[:size] = count[:, :k]
    near[256 : 256 + size] = count[:k, :].T
    sums_in, sums_out = count.sum(axis=0)[:k], count.sum(axis=1)[:k]
    few = np.stack([_nlogn(near + n) - _nlogn(near) for n in range(16)]).astype(np.float32)

    def best(code: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gain = few[np.minimum(n, 15), code]
        many = np.flatnonzero(n > 15)
        if len(many):
            at = near[code[many]]
            gain[many] = _nlogn(at + n[many, None]) - _nlogn(at)
        c = np.add.reduceat(np.where(code < 256, n, 0), first)
        total = np.add.reduceat(gain.astype(np.float64), first, axis=0)
        total -= _nlogn(sums_in + c[:, None]) - _nlogn(sums_in) + _nlogn(sums_out + c[:, None]) - _nlogn(sums_out)
        return c, total.argmax(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_code, held_n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def step(last: bool) -> pa.RecordBatch | None:
            """Sums what is held and in parts by word and code; gives all words but the last one, which may go on."""
            nonlocal held_h, held_code, held_n
            values = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
            h = np.concatenate([held_h, *[p[0] for p in parts]])
            code, n = np.concatenate([held_code, values & 511]), np.concatenate([held_n, values >> 9])
            parts.clear()
            if not len(h):
                return None
            word = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            key, at = np.unique(word << 9 | code, return_inverse=True)
            n, word, code = np.bincount(at, weights=n).astype(np.int64), key >> 9, key & 511
            heads = h[np.concatenate([[True], h[1:] != h[:-1]])]
            cut = len(key) if last else int(np.searchsorted(word, word[-1]))
            held_h, held_code, held_n = np.full(len(key) - cut, heads[-1]), code[cut:], n[cut:]
            if not cut:
                return None
            first = np.flatnonzero(np.concatenate([[True], word[1:cut] != word[: cut - 1]]))
            c, cls = best(code[:cut], n[:cut], first)
            return pa.RecordBatch.from_arrays([pa.array(heads[: len(first)]), pa.array(c), pa.array(cls.astype(np.int32))], names=["h", "c", "cls"])

        waiting = 0
        for batch in batches:
            lists = batch.column("seen")
            lengths = np.diff(lists.offsets.to_numpy())
            parts.append((np.repeat(batch.column("h").to_numpy(), lengths), _flat(batch, "seen")))
            waiting += len(parts[-1][0])
            if waiting > 200_000:
                waiting = 0
                out = step(False)
                if out is not None:
                    yield out
        out = step(True)
        if out is not None:
            yield out

    return seen.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, cls int")


@dataclass
class Model:
    """What scoring needs, all of bounded size but `vocabulary`, a stored table (h, c, cls) of the words that were placed in Spark."""

    vocabulary: DataFrame
    head: np.ndarray  # sorted hashes of the most frequent tokens
    head_log: np.ndarray  # log10(c + 0.5)
    head_class: np.ndarray
    classes: int
    mass: np.ndarray  # D(class), the end's last
    total: int
    distinct: int
    report: list = field(default_factory=list)

    @property
    def everything(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def frequent(vocabulary: DataFrame, most: int = HEAD) -> DataFrame:
    """The most frequent words, at most so many: those from a count on, which a histogram of counts by their logarithm tells."""
    size = F.floor(F.log2("c") * 8).cast("int")
    seen, least = 0, None
    for r in vocabulary.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():  # a few hundred rows
        seen += r.n
        if seen > most:
            break
        least = r["size"]
    return vocabulary.filter("false") if least is None else vocabulary.filter(size >= least)


def learn(train: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES) -> Model:
    """Counts and classes of all words of training rows (h)."""
    counts = stored(token_counts(train), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    first = counts.filter(F.col("h") != END).orderBy(F.desc("c"), "h").limit(clustered).toPandas()
    ends = counts.filter(F.col("h") == END).select("c").first()
    top, top_c = first["h"].to_numpy(dtype=np.int64), first["c"].to_numpy(dtype=np.int64)
    report: list = []
    pairs = bigrams(train, top)
    cls = exchange(pairs, len(top), classes, report=report)
    k = int(cls[: len(top)].max(initial=0)) + 1
    member = np.eye(k + 2)[np.concatenate([cls[: len(top)], [k, k + 1]])]
    order = np.argsort(top, kind="stable")
    seen = contexts(train, top[order], cls[order], k)
    vocabulary = stored(placed(seen, member.T @ pairs @ member, k), "vocabulary")
    release(counts)
    more = frequent(vocabulary).toPandas()
    mass = np.zeros(k + 1)
    np.add.at(mass, cls[: len(top)], top_c + 0.5)
    for r in vocabulary.groupBy("cls").agg(F.sum(F.col("c") + 0.5).alias("d")).collect():
        mass[r.cls] += r.d
    end = [] if ends is None else [END]
    mass[k] = ends.c + 0.5 if end else 0.0
    head = np.concatenate([top, more["h"].to_numpy(dtype=np.int64), np.array(end, dtype=np.int64)])
    head_c = np.concatenate([top_c, more["c"].to_numpy(dtype=np.int64), [ends.c] if end else np.empty(0)])
    head_class = np.concatenate([cls[: len(top)], more["cls"].to_numpy(dtype=np.int64), np.full(len(end), k)])
    order = np.argsort(head, kind="stable")
    return Model(vocabulary, head[order], np.log10(head_c[order] + 0.5), head_class[order].astype(np.uint8), k, mass, int(total), int(distinct), report)


def classed(tokens: DataFrame, model: Model) -> DataFrame:
    """A row per block of texts: ids, held_out, n_tokens, n_known, logs (lists over texts), cls (a byte per token)."""
    sc = tokens.sparkSession.sparkContext
    shared = sc.broadcast((model.head, model.head_log, model.head_class))
    kind = tokens.schema["id"].dataType.simpleString()
    lists = f"ids array<{kind}>, held array<boolean>, n array<int>"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, log, cls = shared.value
        for batch in batches:
            h = _flat(batch)
            at = np.minimum(np.searchsorted(head, h), max(0, len(head) - 1))
            known = head[at] == h if len(head) else np.zeros(len(h), dtype=bool)
            codes = np.where(known, cls[at], LATER).astype(np.uint8) if len(head) else np.full(len(h), LATER, np.uint8)
            logs = np.where(known, log[at], 0.0) if len(head) else np.zeros(len(h))
            starts = batch.column("h").offsets.to_numpy()
            starts = starts - starts[0]
            rest, place = np.unique(h[~known], return_inverse=True)
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(one, batch.column("id")), pa.ListArray.from_arrays(one, batch.column("held_out")), pa.ListArray.from_arrays(one, pa.array(np.diff(starts).astype(np.int32))),
                 pa.ListArray.from_arrays(one, pa.array(np.add.reduceat(logs, starts[:-1]))), pa.array([codes.tobytes()]), pa.array([place.astype("<i4").tobytes()]),
                 pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), pa.array(rest))],
                names=["ids", "held", "n", "logs", "cls", "place", "rest"],
            )

    blocks = tokens.select("id", "held_out", "h").mapInArrow(begin, f"{lists}, logs array<double>, cls binary, place binary, rest array<long>")
    blocks = stored(blocks.withColumn("tag", F.monotonically_increasing_id()), "text-blocks")
    asked = blocks.select("tag", F.posexplode("rest").alias("j", "h"))
    told = asked.join(model.vocabulary, "h").groupBy("tag").agg(F.collect_list("j").alias("js"), F.collect_list("c").alias("cs"), F.collect_list(F.col("cls").cast("int")).alias("ks"))
    joined = blocks.select("tag", "ids", "held", "n", "logs", "cls", "place", F.size("rest").alias("size")).join(told, "tag", "left")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, logs = (np.array(batch.column(c)[i].values) for c in ("n", "logs"))
                codes, place = np.frombuffer(batch.column("cls")[i].as_py(), dtype=np.uint8).copy(), np.frombuffer(batch.column("place")[i].as_py(), dtype="<i4")
                size = batch.column("size")[i].as_py()
                c, k = np.zeros(size), np.full(size, UNKNOWN, np.uint8)
                if batch.column("js")[i].is_valid:
                    j = np.array(batch.column("js")[i].values)
                    c[j], k[j] = np.array(batch.column("cs")[i].values), np.array(batch.column("ks")[i].values)
                later = np.flatnonzero(codes == LATER)
                codes[later] = k[place]
                more = np.zeros(len(codes))
                more[later] = np.log10(c[place] + 0.5)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                known = np.add.reduceat((codes != UNKNOWN).astype(np.int32), first)
                one = pa.array([0, len(n)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[pa.ListArray.from_arrays(one, batch.column(x)[i].values) for x in ("ids", "held", "n")], pa.ListArray.from_arrays(one, pa.array(known.astype(np.int32))),
                     pa.ListArray.from_arrays(one, pa.array(logs + np.add.reduceat(more, first))), pa.array([codes.tobytes()])],
                    names=["ids", "held", "n", "known", "logs", "cls"],
                )

    out = stored(joined.mapInArrow(end, f"{lists}, known array<int>, logs array<double>, cls binary"), "classed-texts")
    release(blocks)
    return out


def _steps(codes: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(class before, class) of a block's tokens: words' classes, the end k, unknown words k + 1; the end stands before a text."""
    c = np.frombuffer(codes, dtype=np.uint8).astype(np.int64)
    c = np.where(c == UNKNOWN, k + 1, c)
    return np.concatenate([[k], c[:-1]]), c


def transitions(blocks: DataFrame, k: int) -> np.ndarray:
    """Counts of class pairs of training texts: (k + 2) squared."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 2) ** 2, dtype=np.int64)
        for batch in batches:
            for held, n, codes in zip(*(batch.column(x) for x in ("held", "n", "cls")), strict=True):
                before, c = _steps(codes.as_py(), k)
                train = np.repeat(~np.array(held.values.to_numpy(zero_copy_only=False), dtype=bool), np.array(n.values))
                total += np.bincount((before * (k + 2) + c)[train], minlength=(k + 2) ** 2)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "c"])

    return _matrix(blocks.select("held", "n", "cls").mapInArrow(partial, "pair long, c long"), k + 2, k + 2)


def token_logs(count: np.ndarray, model: Model, mix: float = MIX, smooth: float = SMOOTH) -> np.ndarray:
    """log10 of what a token's c + 0.5 (0.5 where unknown) is multiplied with, by class before and class."""
    k, everything = model.classes, model.everything
    c = count[:, : k + 1]
    share = (c.sum(axis=0) + 0.5) / (c.sum(axis=0) + 0.5).sum()
    move = (c + smooth * share) / (c.sum(axis=1, keepdims=True) + smooth)
    move[k + 1] = share
    known = (1 - 0.5 / everything) * (mix * move / np.where(model.mass > 0, model.mass, 1.0) + (1 - mix) / max(everything - 0.5, 0.5))
    return np.log10(np.concatenate([np.maximum(known, 1e-300), np.full((k + 2, 1), 1 / everything)], axis=1))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("id"), (fold(F.col(id_col)) == 1).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("txt"))
    tokens = stored(token_rows(d), "tokens")
    model = learn(tokens.filter("not held_out"))
    blocks = classed(tokens, model)
    k, part, everything = model.classes, token_logs(transitions(blocks, model.classes), model), model.everything
    release(tokens, model.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, logs = (np.array(batch.column(x)[i].values) for x in ("n", "logs"))
                before, c = _steps(batch.column("cls")[i].as_py(), k)
                parts = np.add.reduceat(part[before, c], np.concatenate([[0], np.cumsum(n)[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[i].values, batch.column("held")[i].values, pa.array(n.astype(np.int64)), pa.array(np.array(batch.column("known")[i].values).astype(np.int64)),
                     pa.array(logs - n * np.log10(everything)), pa.array(logs + parts)],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = blocks.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op6_brown_scores(spark, sf_dir: str) -> DataFrame:
    """Query: the scores of every document."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
