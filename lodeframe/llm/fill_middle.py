"""Fill-in-the-middle transformation: DuckDB SQL over each Arrow batch inside mapInArrow, without Python for a row.

A document is cut into tokens (words with the white space before them). Two units drawn from its id bound the middle; the parts
are put in one of two orders under sentinels, or the text stays plain. All of it is a function of seed, id and text, so tasks may be run again.

Null text is the empty text, and a null id draws as an empty one. Empty texts, and texts that hold a sentinel, stay plain. Very long texts are a batch of
their own. Repeated rows each give their row, equal ones; an empty table gives an empty one. Only id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lodeframe.llm.store import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
DIGEST = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType()))])
TEXTS = T.StructType([T.StructField("output", T.StringType()), T.StructField("restored", T.StringType())])


def statement(seed: int, fim_percent: int, spm_percent: int, wanted: str) -> str:
    """The SQL over a view named batch, of doc_id and text, that gives the columns wanted."""
    drawn = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    return f"""
        WITH cut AS (
          SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS tokens, sha256(concat('{seed}:', CAST(doc_id AS VARCHAR))) AS digest
          FROM (SELECT doc_id, coalesce(text, '') AS text FROM batch)),
        drawn AS (SELECT doc_id, text, tokens, len(tokens) AS n, {drawn} FROM cut),
        placed AS (
          SELECT doc_id, text, tokens, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {fim_percent} THEN 'plain'
                 WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
          FROM drawn),
        parts AS (
          SELECT doc_id, text, n, form,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, 1, a), '') END AS prefix,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, a + 1, b), '') END AS middle,
            CASE WHEN form <> 'plain' THEN array_to_string(list_slice(tokens, b + 1, n), '') END AS suffix
          FROM placed),
        made AS (
          SELECT doc_id, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
            CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle)
              ELSE concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) END AS output
          FROM parts),
        split AS (
          SELECT *, instr(output, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS second, instr(output, '{MIDDLE}') AS third FROM made),
        rebuilt AS (
          SELECT *, CASE form WHEN 'plain' THEN output
              WHEN 'psm' THEN concat(substr(output, 4, second - 4), substr(output, third + 3), substr(output, second + 3, third - second - 3))
              ELSE concat(substr(output, second + 3, third - second - 3), substr(output, third + 3), substr(output, 4, second - 4)) END AS restored
          FROM split)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256{wanted} FROM rebuilt"""


def fill_middle(documents: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, n (tokens), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, with keep_text, output and restored.

    restored is rebuilt from output and form alone. Tasks hold one Arrow batch and its tokens.
    """
    bounded_batches(documents.sparkSession)
    schema = T.StructType(DIGEST.fields + TEXTS.fields) if keep_text else DIGEST
    sql, arrow = statement(seed, fim_percent, spm_percent, ", output, restored" if keep_text else ""), to_arrow_schema(schema)

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as engine:
            for batch in batches:
                engine.register("batch", pa.Table.from_batches([batch]))
                for part in engine.sql(sql).to_arrow_reader(2048):
                    yield from pa.Table.from_batches([part]).cast(arrow).to_batches()
                engine.unregister("batch")

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(transform, schema)


ORACLE = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
    list_transform([0, 1, 2, 3], lambda k: CAST('0x' || substr(sha256('42:' || doc_id), 8 * k + 1, 8) AS BIGINT)) AS h
  FROM documents),
f AS (
  SELECT *, len(t) AS n, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (
  SELECT *, coalesce(list_sum(list_transform(t[1:least(h[1] % (n + 1), h[2] % (n + 1))], lambda x: length(x))), 0) AS a,
    coalesce(list_sum(list_transform(t[1:greatest(h[1] % (n + 1), h[2] % (n + 1))], lambda x: length(x))), 0) AS b FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || left(text, a::BIGINT) || '<S>' || substr(text, b::BIGINT + 1) || '<M>' || substr(text, a::BIGINT + 1, (b - a)::BIGINT)
    ELSE '<S>' || substr(text, b::BIGINT + 1) || '<P>' || left(text, a::BIGINT) || '<M>' || substr(text, a::BIGINT + 1, (b - a)::BIGINT) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
