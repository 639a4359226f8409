"""Line deduplication by an exact set-similarity join of line tokens.

The tokens of a line (its distinct words, A-Z lower-cased) are ordered by rarity; prefix, positional and length filters choose pairs of lines, exact Jaccard similarity
decides (see ``line_join``). A line is removed if, and only if, a line before it, by document id and line number, has a similarity of ``num / den`` (0.8) or more, in the same
document or in another; whether that earlier line is itself removed does not matter. ``least`` (1) is the number of distinct words a line needs to be looked at.

Defined cases: null and empty texts and lines without words have nothing to remove; a null id sorts first; of equal lines, of one document or of several, the first stays;
lines of different words at one place (rows that share an id) count in the order of their keys, and of equal ones each is its own first; rows that share an id share their
verdicts by line number in ``later_lines``, by number and words in ``remove_lines``; a line without blanks (Chinese, Japanese, Thai) is one word, so only equal ones match;
an empty table gives no rows; ids are cast to long, one that is no number counts as null; other columns pass through ``remove_lines`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earlywarn.llm import line_join, setjoin

NUM, DEN = 4, 5
LEAST = 1
#: Rows whose texts are rewritten at once, whatever the size of Spark's batches.
ROWS = 256


def _later(docs: DataFrame, doc_id: str, text: str, num: int, den: int, least: int) -> DataFrame:
    """``row, part, key`` of each line that matches an earlier one: its document's id, its number and the key of its words."""
    rows = docs.select(F.col(doc_id).try_cast("long").alias("id"), F.col(text).alias("text"))
    members, heads = line_join.earlier_matches(rows, setjoin.line_sets(least), num, den)
    place = F.struct("row", "part")
    later = members.join(heads, "key").where(F.col("matched") | ~place.eqNullSafe(F.col("first")))
    return later.select("row", "part", "key")


def later_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, least: int = LEAST) -> DataFrame:
    """``id, removed`` (sorted line numbers from 0): the lines that match an earlier one, for documents that have such lines."""
    out = _later(docs, doc_id, text, num, den, least)
    return out.groupBy(F.col("row").alias("id")).agg(F.sort_array(F.collect_set("part")).alias("removed"))


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN, least: int = LEAST) -> DataFrame:
    """``docs`` with the later lines taken out of ``text``. A document that had words and has none left is dropped. Rows that share an id (all null ids are one)
    lose a line only where its own words have the key that was found, so none loses a line for another row's."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    i, at = names[docs.columns.index(doc_id)], docs.columns.index(text)
    later = _later(docs, doc_id, text, num, den, least)
    gone = later.groupBy(F.col("row").alias("id")).agg(F.collect_set(F.struct("part", "key")).alias("removed"))

    extract = setjoin.line_sets(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            texts = b.column(at).to_pylist()
            keep = [True] * len(texts)
            marked = [(k, {(x["part"], x["key"]) for x in r}) for k, r in enumerate(b.column(len(names)).to_pylist()) if r and texts[k]]
            out: list[set[int]] = [set() for _ in marked]
            for row, part, values, n in extract(pa.RecordBatch.from_arrays([pa.array([texts[k] for k, _ in marked], pa.string())], names=["t"])):
                for r, line, key in zip(row.tolist(), part.tolist(), setjoin.digest(values, n).tolist(), strict=True):
                    if (line, key) in marked[r][1]:
                        out[r].add(line)
            for (k, _), gone_lines in zip(marked, out, strict=True):
                if gone_lines:
                    texts[k] = "\n".join(line for n, line in enumerate(texts[k].split("\n")) if n not in gone_lines)
                    keep[k] = bool(texts[k].strip("\t\n\x0b\x0c\r "))
            cols = list(b.columns[: len(names)])
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    schema = ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True))
    joined = docs.toDF(*names).join(gone, F.col(i).try_cast("long").eqNullSafe(F.col("id")), "left").select(*names, "removed")
    return joined.mapInArrow(run, schema).toDF(*docs.columns)
