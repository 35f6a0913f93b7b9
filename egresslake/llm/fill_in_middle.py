r"""Operator 11: fill-in-middle transformation of texts.

A text is decoded to a UTF-32 array of code points. A code point is a space or not; where a neighbour's
class changes from text to space, a token ends, and so does the text. A token is a word with the
spaces before it; spaces at the end of the text are a token. Of the boundaries so found, two are chosen by
rank, and the array is sliced there into prefix, middle and suffix, which are encoded and put together:
psm is <P>prefix<S>suffix<M>middle, spm is <S>suffix<P>prefix<M>middle, plain is the text.

Ranks and form follow from a hash of the seed and the row's id, so reruns and lost executors give the
same result, wherever a row is. No row is shuffled.

Defined results: a null text counts as empty; an empty text is plain, with no tokens; a text that holds a
marker is plain, so an output can always be taken apart; a null id is hashed as the empty text; rows
that repeat get equal results; further columns are kept, and may have any name but those that are added; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from egresslake.llm.common import small_batches

SEED = 42
#: Percent of the texts that are cut, and percent of those that begin with the suffix.
CUT, SUFFIX_FIRST = 50, 80
#: Markers of prefix, suffix and middle. No marker may begin as it, or another, ends: else outputs could not be taken apart.
MARKERS = ("<P>", "<S>", "<M>")
ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def boundaries(codes: np.ndarray) -> np.ndarray:
    """Ends (exclusive) of the tokens of an array of code points."""
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    return np.append(np.flatnonzero(space[1:] & ~space[:-1]) + 1, len(codes))


def draws(seed: int, row_id: str) -> list[int]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{row_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(text: str | None, row_id: str, seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = boundaries(codes)
    h1, h2, h3, h4 = draws(seed, row_id)
    if not len(codes) or h3 % 100 >= cut or any(m in text for m in markers):
        return len(ends), "plain", None, None, text
    a, b = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
    prefix, middle, suffix = (codes[i:j].tobytes().decode("utf-32-le", "surrogatepass") for i, j in ((0, a), (a, b), (b, len(codes))))
    p, s, m = markers
    if h4 % 100 < suffix_first:
        return len(ends), "spm", a, b - a, s + suffix + p + prefix + m + middle
    return len(ends), "psm", a, b - a, p + prefix + s + suffix + m + middle


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """docs, all columns, with n (tokens), form, prefix_chars, middle_chars (NULL if plain) and output."""
    small_batches(docs.sparkSession)
    given = tuple(markers)

    @F.pandas_udf(ADDED)
    def cut_up(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transformed(t, i, seed, cut, suffix_first, given) for i, t in zip(ids, texts, strict=True)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in ADDED.split(", ")])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = docs.withColumn("_el_fim", cut_up(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns], "_el_fim.*")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of: the parts between its markers in the order prefix, middle, suffix."""
    p, s, m = markers

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(F.substring(output, len(first) + 1, F.length(output)), second, 1)
        rest = F.substring(output, F.length(head) + len(first) + len(second) + 1, F.length(output))
        body = F.substring_index(rest, m, 1)
        return head, body, F.substring(rest, F.length(body) + len(m) + 1, F.length(output))

    prefix, suffix, middle = between(p, s)
    late, early, inner = between(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, inner, late)).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Query: tokens, form and cuts of every text, with digests of the output and of the text rebuilt from it."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t
  FROM documents),
drawn AS (
  SELECT doc_id, text, t, len(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM tokens),
formed AS (
  SELECT doc_id, text, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s
  FROM formed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""
