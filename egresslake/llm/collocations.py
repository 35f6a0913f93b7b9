r"""Operator 12: phrase collocation mining with count-min sketches.

1. Each task counts hashes of all n-grams (1 to LONGEST words, within a piece of text) in a count-min sketch of
   its own: ROWS rows of cells, whose number follows the corpus, up to MOST_BITS. Counters stop at `least`,
   which is all that the question "at least that often?" needs, and so take one byte. Sketches are merged in Spark by segments of
   cells, and a merged cell becomes one bit: has it reached `least`?
   In large corpora the sketch would fill up with rare n-grams, most of them pairs of words, so it is made again for longer
   n-grams, then only of those whose shorter n-grams have the bit (`passes_over`).
2. A last pass counts exactly the n-grams whose cells have all the bit, and of which both shorter n-grams, without the
   last and without the first word, have it too. A sketch only overestimates, so no n-gram that is frequent is lost;
   whatever survives in error is counted exactly and dropped.
3. Frequent phrases are cut in two at each place, scored by the weakest cut, and dropped where a longer phrase explains them.

The driver and each task hold the merged bits: ROWS x 2^MOST_BITS / 8 bytes = 16 MiB at most for each pass, 2 MiB at 2^23 cells; there are up
to LONGEST passes. Beyond some billion words MOST_BITS lets more rare n-grams through, and the last pass counts more; results are the same. A
sketch's memory in a task is ROWS x 2^MOST_BITS bytes = 128 MiB at most. Texts are read in chunks of about CHUNK bytes; a longer text is a chunk.

Inside a chunk, words get numbers from Arrow's dictionary encoding, and n-grams are told apart by pairs of (number of the n-gram without its
last word, number of the last word), so counts are exact: hashes serve the sketch only.

Defined results: a null text counts as empty, a null lang as "und"; empty texts and texts of separators give nothing, though
a lang whose texts have no words has no rows; texts of one word give no phrase; rows that repeat count each time; ties in score and
count are ordered by the phrase's UTF-8 bytes; ids are not used; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from egresslake.llm.common import semi_left, small_batches, stored
from egresslake.llm.shingles import mixed, powers

LONGEST, LEAST, TOP = 4, 30, 2000
#: A longer phrase explains a shorter one that occurs in it at least this often, in percent.
EXPLAINED = 80
ROWS, FEWEST_BITS, MOST_BITS = 2, 16, 26
#: Cells are added for so many n-grams each.
LOAD = 8
#: N-grams of all lengths share a sketch up to so many a cell, words and pairs up to FULL_2.
FULL, FULL_2 = 24, 64
SEGMENT_BITS = 18
CHUNK = 8 << 20
_U = np.uint64
_STEP, _ROW = _U(0x9E3779B97F4A7C15), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3))

#: Per byte: the byte in lower case (A to Z only), and its class: 0 of a word, 1 blank, 2 separator of pieces.
_BLANKS, _SEPARATORS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CLASS = bytes(1 if b in _BLANKS else 2 if b in _SEPARATORS else 0 for b in range(256))
#: Words up to so many bytes are hashed as sums.
_SHORT = 1024
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _STEP)


def words(blob: bytes) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """(number of each word occurrence, distinct words, piece of each occurrence)."""
    kind = np.frombuffer(blob.translate(_CLASS), dtype=np.uint8)
    inside = np.zeros(len(kind) + 2, dtype=bool)
    np.equal(kind, 0, out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(blob.translate(_LOWER, _BLANKS + _SEPARATORS))])
    coded = found.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.empty(0, dtype=np.int32)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, piece


def word_hashes(distinct: pa.BinaryArray, lang: str) -> np.ndarray:
    """A hash of each word and lang: sums over a word's bytes, mixed."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    _, offsets, data = distinct.buffers()
    if not len(distinct):
        return np.zeros(0, dtype=np.uint64)
    edge = np.frombuffer(offsets, dtype=np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    raw, size = np.frombuffer(data, dtype=np.uint8)[edge[0] : edge[-1]], np.diff(edge)
    place = np.arange(len(raw)) - np.repeat(edge[:-1] - edge[0], size)
    out = np.add.reduceat(_BYTE[raw] * powers(_SHORT)[place % _SHORT], edge[:-1] - edge[0])
    for i in np.flatnonzero(size > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(distinct[i].as_py())
    return mixed(out ^ _U(seed))


def gram_hashes(hashes: np.ndarray, piece: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to longest: (hash of the n-gram that begins at each place, whether it ends within the piece)."""
    h, whole = hashes, np.ones(len(hashes), dtype=bool)
    yield h, whole
    for n in range(2, longest + 1):
        if len(hashes) < n:
            yield h[:0], whole[:0]
            continue
        h = mixed(h[: len(hashes) - n + 1] * _STEP + hashes[n - 1 :])
        whole = piece[: len(hashes) - n + 1] == piece[n - 1 :]
        yield h, whole


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((h * _ROW[row]) >> _U(64 - bits)).astype(np.uint32)


def counters(least: int) -> np.dtype:
    """The least type of counters that stop at `least`."""
    return np.min_scalar_type(least)


def add_to(sketch: np.ndarray, h: np.ndarray, bits: int, least: int, times: np.ndarray | None = None) -> None:
    """Counts hashes, each once or `times`, in a sketch of len(sketch) rows; no counter passes `least`."""
    for row in range(len(sketch)):
        if times is None:
            cell, n = np.unique(cells(h, row, bits), return_counts=True)
        else:
            cell, at = np.unique(cells(h, row, bits), return_inverse=True)
            n = np.bincount(at, weights=times, minlength=len(cell)).astype(np.int64)
        sketch[row, cell] = np.minimum(sketch[row, cell] + n, least)


def passes(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether all cells of a hash have reached `least`: bitmap is packed, little end first, by rows."""
    out = np.ones(len(h), dtype=bool)
    for row in range(len(bitmap)):
        c = cells(h, row, bits)
        out &= (bitmap[row, c >> 3] >> (c & 7).astype(np.uint8)) & 1 == 1
    return out


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[str, bytes]]:
    """(lang, texts of that lang, joined by a separator) of about so many bytes; batches have lang and text as binary."""
    held: dict[str, list[bytes]] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(text)
            total += len(text)
            if total >= size:
                yield from ((k, b"\n".join(v)) for k, v in held.items())
                held, total = {}, 0
    yield from ((k, b"\n".join(v)) for k, v in held.items())


def width(size: int, longest: int = LONGEST) -> int:
    """Bits of a cell's number for texts of so many bytes: a word takes about six."""
    grams = max(1, size * longest // 6)
    return min(MOST_BITS, max(FEWEST_BITS, int(grams // LOAD).bit_length()))


def passes_over(size: int, bits: int, longest: int = LONGEST) -> list[range]:
    """Lengths of n-grams that share a sketch: all, or words and pairs before longer ones, or each by itself, by how many a cell gets."""
    words_a_cell = size / 6 / (1 << bits)
    if words_a_cell * longest <= FULL:
        return [range(1, longest + 1)]
    if words_a_cell * 2 <= FULL_2:
        return [r for r in (range(1, min(2, longest) + 1), range(3, longest + 1)) if r]
    return [range(n, n + 1) for n in range(1, longest + 1)]


def candidates(ids: np.ndarray, hashes: np.ndarray, piece: np.ndarray, maps: dict[int, np.ndarray], bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: (n, hash of the n-gram that begins at each place, places of those that may be frequent); hashes are the distinct words'.

    An n-gram may be frequent if both shorter ones may be, and if it passes the bitmap of n, where maps has it.
    """
    before = np.zeros(0, dtype=bool)
    for n, (h, whole) in enumerate(gram_hashes(hashes[ids], piece, longest), 1):
        if n == 1:
            at = np.flatnonzero(passes(maps[1], hashes, bits)[ids]) if 1 in maps else np.arange(len(ids))
        else:
            at = np.flatnonzero(whole & before[: len(h)] & before[1 : len(h) + 1])
            if n in maps:
                at = at[passes(maps[n], h[at], bits)]
        yield n, h, at
        before = np.zeros(len(h), dtype=bool)
        before[at] = True


def merged_sketch(texts: DataFrame, bits: int, least: int, lengths: range, known: Broadcast, rows: int = ROWS) -> np.ndarray:
    """Packed bits (rows, 2^bits / 8): which cells of the merged sketch of n-grams of these lengths have reached `least`. known: bitmaps by length."""
    part = min(SEGMENT_BITS, bits)
    kind = counters(least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((rows, 1 << bits), dtype=kind)
        for lang, blob in chunks(batches):
            ids, distinct, piece = words(blob)
            if not len(ids):
                continue
            hashes = word_hashes(distinct, lang)
            for n, h, at in candidates(ids, hashes, piece, known.value, bits, lengths[-1]):
                if n in lengths and n == 1:
                    add_to(sketch, hashes, bits, least, np.bincount(ids))
                elif n in lengths:
                    add_to(sketch, h[at], bits, least)
        segments = sketch.reshape(-1, 1 << part)
        for k in np.flatnonzero(segments.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([segments[k].tobytes()], pa.binary())], names=["k", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, acc = -1, np.zeros(0, dtype=kind)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(acc >= least, bitorder="little").tobytes()], pa.binary())], names=["k", "cells"])

        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(raw.as_buffer(), dtype=kind)
                if k != at:
                    if at >= 0:
                        yield packed()
                    at, acc = k, new
                else:
                    acc = np.minimum(acc.astype(np.uint64) + new, least).astype(kind)
        if at >= 0:
            yield packed()

    # a sketch is as large for few texts as for many: few tasks make one each
    tasks = max(1, 2 * texts.sparkSession.sparkContext.defaultParallelism)
    counted = texts.coalesce(tasks).mapInArrow(count, "k int, cells binary")
    bitmap = np.zeros((rows << (bits - part), (1 << part) // 8), dtype=np.uint8)
    for r in counted.repartition("k").sortWithinPartitions("k").mapInArrow(merge, "k int, cells binary").collect():
        bitmap[r["k"]] = np.frombuffer(r["cells"], dtype=np.uint8)
    return bitmap.reshape(rows, -1)


def survivors(ids: np.ndarray, hashes: np.ndarray, piece: np.ndarray, maps: dict[int, np.ndarray], bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: (n, first place of each distinct n-gram that may be frequent, its occurrences)."""
    group, size = ids, len(hashes)
    for n, h, at in candidates(ids, hashes, piece, maps, bits, longest):
        if n == 1:
            first, times = np.zeros(size, dtype=np.int64), np.bincount(ids[at], minlength=size)
            first[ids[at][::-1]] = at[::-1]
            yield n, first[times > 0], times[times > 0]
            continue
        _, first, inverse, times = np.unique(group[at] * size + ids[at + n - 1], return_index=True, return_inverse=True, return_counts=True)
        yield n, at[first], times
        group = np.zeros(len(h), dtype=np.int64)
        group[at] = inverse


def frequent(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all n-grams that occur at least so often, (lang, n) of all words), both stored."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = width(size, longest)
    sc, maps = docs.sparkSession.sparkContext, {}
    known = sc.broadcast(maps)
    for lengths in passes_over(size, bits, longest):
        bitmap = merged_sketch(texts, bits, least, lengths, known)
        known.unpersist()
        known = sc.broadcast(maps := maps | dict.fromkeys(lengths, bitmap))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, blob in chunks(batches):
            ids, distinct, piece = words(blob)
            if not len(ids):
                continue
            out = [([b""], [0], [len(ids)])]
            for n, first, times in survivors(ids, word_hashes(distinct, lang), piece, known.value, bits, longest):
                parts = [distinct.take(pa.array(ids[first + k])) for k in range(n)]
                phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, b" ")
                out.append((phrase, np.full(len(first), n, dtype=np.int32), times))
            for phrase, n, times in out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(phrase, pa.binary()), pa.array(n, pa.int32()), pa.array(times, pa.int64())], names=["lang", "phrase", "words", "f"]
                )

    found = texts.mapInArrow(count, "lang string, phrase binary, words int, f long").groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))
    both = stored(found.filter((F.col("f") >= least) | (F.col("words") == 0)).select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), "phrases")
    known.unpersist()
    return both.filter("words > 0"), both.filter("words = 0").select("lang", F.col("f").alias("n"))


def scored(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): the weakest cut of each phrase of two words or more; the first of equal ones."""
    split = F.split("phrase", " ")
    cuts = phrases.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), split.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right")
    )
    parts = phrases.select("lang", "phrase", "f")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    least = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def explained(phrases: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, most): for phrases inside longer frequent ones, the longer ones' greatest count."""
    w = F.split("phrase", " ")

    def of(size: int) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.col("words") - size + 1, F.lit(1)))
        return F.when(F.col("words") > size, F.transform(at, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))).otherwise(F.array().cast("array<string>"))

    inner = [of(size) for size in range(2, longest)]
    if not inner:
        return phrases.select("lang", "phrase", F.col("f").alias("most")).limit(0)
    return phrases.filter("words > 2").select("lang", F.explode(F.concat(*inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, share: int = EXPLAINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's phrases by score, count and bytes; the first `top`, or all."""
    phrases, totals = frequent(docs, text_col, lang_col, least, longest)
    kept = scored(phrases).join(explained(phrases, longest), ["lang", "phrase"], "left")
    gone = F.expr(f"cast(100 as decimal(3,0)) * cast(most as decimal(19,0)) >= cast({int(share)} as decimal(10,0)) * cast(a as decimal(19,0))")
    kept = kept.filter(F.col("most").isNull() | ~gone)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked.filter(F.col("rank") <= top) if top else ranked  # Spark then sends only the first `top` of each task
    return semi_left(ranked, totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """Query: the first 2000 collocations of each lang."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, k, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, k, phrase, a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS x, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k > 1)),
valued AS (
  SELECT cuts.*, p.a AS l, q.a AS r, ((2000000::HUGEINT * cuts.a) // (p.a::HUGEINT + q.a))::BIGINT AS score
  FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = cuts.x JOIN f q ON q.lang = cuts.lang AND q.phrase = cuts.y),
best AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + s - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, phrase, a, k, s, unnest(range(1, k - s + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS s) WHERE k > s) GROUP BY ALL),
kept AS (
  SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept) JOIN totals USING (lang)
WHERE rank <= 2000"""
