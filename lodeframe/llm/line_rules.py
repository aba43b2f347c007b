"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much of its text is rejected.

Lines are split at \\n; one without a word is neither judged nor counted. In this order, a line fails

* punctuation, if no sentence ends in it (a terminal mark before white space or the line's end), or runs of marks stand beside too many of its words;
* navigation, if separators of menus stand between its words as often as one for each five;
* boilerplate, if it is short and holds a phrase of notices, or if the document has had it twice before.

Work goes in Arrow batches of bounded bytes with vectorised functions; a text longer than that is a batch of its own. Null and empty texts have no words and are
rejected. Repeated rows each give their row; an empty table gives an empty one. Only id and text are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import textkit
from lodeframe.llm.store import bounded_batches

SYMBOLS = "#*$%&|<>"
SENTENCE_END = r"""[.!?…。！？]["'”’»)\]]*([\x20\x09-\x0D]|$)"""
MARK_RUN = r"[!?#*$%&<>~^=]{2,}"
SEPARATOR = r"[|•·›»→]"
NOTICE = r"(?i)\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|copyright|click here|sign (in|up)|log ?in|subscribe|newsletter|enable javascript|lorem ipsum|skip to (main )?content|read more|powered by|licensed under|back to top)\b"
NOTICE_WORDS = 30  # a longer line with such a phrase is prose about it
MOST_LOST = 50  # percent of the characters of words
_SPACES = np.array([0x20, *range(0x09, 0x0E)], np.uint8)
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, chars_lost long, text string"


def _by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _repeated_words(words: textkit.Words, rows: int) -> np.ndarray:
    """Of each row, the words that lie in a window of three which the row holds twice or more."""
    at = words.windows(3)
    codes = textkit.rolling(words.hashes(), 3)[at]
    row = words.row[at]
    order = np.lexsort((codes, row))
    same = (codes[order][1:] == codes[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    covered = np.zeros(len(words.row), bool)
    for k in range(3):
        covered[at[order[again]] + k] = True
    return np.bincount(words.row[covered], minlength=rows)


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lines of an array of texts, and where each text's lines begin."""
    split = pc.split_pattern(texts, "\n")
    return split.flatten(), split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()


def _seen_before(lines: pa.Array, row: np.ndarray) -> np.ndarray:
    """For each line, how many equal ones of its row come before it."""
    codes = lines.dictionary_encode().indices.to_numpy()
    order = np.lexsort((np.arange(len(codes)), codes, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (row[order][1:] != row[order][:-1])
    place = np.arange(len(order))
    seen = np.empty(len(order), np.int64)
    seen[order] = place - np.maximum.accumulate(np.where(fresh, place, 0))
    return seen


def _judged(part: textkit.Slice, texts: pa.Array, most_lost: int) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The figures of each text of a slice, and the text of the lines that stand."""
    words = part.words()
    whole = ~np.isin(part.data, _SPACES) & ((part.data & 0xC0) != 0x80)  # the first bytes of the characters of words
    n_words, word_chars = words.count, _by_row(whole, part.bounds)
    n_symbols = _by_row(np.isin(part.data, np.frombuffer(SYMBOLS.encode(), np.uint8)), part.bounds)
    n_repeat = _repeated_words(words, part.rows)

    lines, first = _lines(texts)
    row = np.repeat(np.arange(part.rows), np.diff(first))
    _, offsets, _ = lines.buffers()
    begin = np.frombuffer(offsets, np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    begin = begin - begin[0] + np.arange(len(lines) + 1) - np.append(row, part.rows)  # places in the slice, which has the \n between lines of a text
    last = begin[:-1] + pc.binary_length(lines).to_numpy()
    held = np.searchsorted(words.start, last) - np.searchsorted(words.start, begin[:-1])
    chars = np.concatenate([[0], np.cumsum(whole)])
    chars = chars[last] - chars[begin[:-1]]
    count = lambda pattern: pc.count_substring_regex(lines, pattern).to_numpy()
    has = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    seen = _seen_before(lines, row)
    separators = count(SEPARATOR)
    fails = ~has(SENTENCE_END) | (10 * count(MARK_RUN) > 3 * held)
    fails |= (separators > 0) & (5 * separators >= held)
    fails |= ((held <= NOTICE_WORDS) & has(NOTICE)) | (seen >= 2)
    fails &= held > 0
    lost = _by_row(chars * fails, first)
    base_failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    stay = pc.filter(lines, pa.array(~fails))
    bounds = np.concatenate([[0], np.cumsum(_by_row(~fails, first))])
    cleaned = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), stay), "\n")
    figures = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": _by_row((seen > 0) & (held > 0), first), "n_repeat_words": n_repeat,
        "base_failed": base_failed, "kept": ~base_failed & (100 * lost <= most_lost * word_chars), "lines_removed": _by_row(fails, first), "chars_lost": lost,
    }
    return figures, cleaned


def clean_lines(documents: DataFrame, most_lost: int = MOST_LOST, keep_text: bool = True) -> DataFrame:
    """Per document: doc_id, the base figures, base_failed, kept, lines_removed, chars_lost and, with keep_text, the text of the lines that stand.

    kept is false if the base rules fail or the removed lines hold more than most_lost percent of the characters of words. One pass, without a shuffle.
    """
    bounded_batches(documents.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = textkit.text_column(batch, "text").fill_null("")
            for part in textkit.slices(texts):
                figures, cleaned = _judged(part, texts.slice(part.first, part.rows), most_lost)
                columns = [batch.column(0).slice(part.first, part.rows)] + [pa.array(figures[n], pa.bool_() if figures[n].dtype == bool else pa.int64()) for n in names[1:-1]]
                yield pa.RecordBatch.from_arrays(columns + [cleaned] * keep_text, names=names if keep_text else names[:-1])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(clean, SCHEMA if keep_text else SCHEMA.rsplit(",", 1)[0])


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
b AS (
  SELECT r, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
g AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g3 AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS times FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g3 WHERE times >= 2) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
l1 AS (
  SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS held, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    len(regexp_extract_all(line, '{MARK_RUN}')) AS marks, len(regexp_extract_all(line, '{SEPARATOR}')) AS separators, row_number() OVER (PARTITION BY r, line ORDER BY i) - 1 AS seen FROM l0),
l2 AS (
  SELECT *, held > 0 AND (NOT regexp_matches(line, '{SENTENCE_END.replace("'", "''")}') OR 10 * marks > 3 * held OR (separators > 0 AND 5 * separators >= held)
    OR (held <= {NOTICE_WORDS} AND regexp_matches(line, '{NOTICE}')) OR seen >= 2) AS fails FROM l1),
l AS (SELECT r, count(*) FILTER (seen > 0 AND held > 0) AS n_dup_lines, count(*) FILTER (fails) AS lines_removed, coalesce(sum(chars) FILTER (fails), 0) AS chars_lost FROM l2 GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed,
  (n_words >= 50 AND 100 * coalesce(n_repeat_words, 0) <= 50 * n_words AND 100 * chars_lost <= {MOST_LOST} * word_chars) AS kept,
  lines_removed::BIGINT AS lines_removed, chars_lost::BIGINT AS chars_lost
FROM b JOIN l USING (r) LEFT JOIN rep USING (r)
"""
