"""Exact search for a table of questions in one pass over the documents."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagelake.operators.runs import query_terms
from pagelake.operators.shared import join_counted, written

#: Bytes of the terms that are looked for in one pass, and terms of a question.
PASS_BYTES, TERMS = 8 << 20, 8


def _passes(terms: DataFrame, limit: int) -> Iterator[list[str]]:
    """Distinct terms in lists of some MB; the driver holds one list at a time."""
    some, size = [], 0
    for row in terms.toLocalIterator():
        some.append(row.term)
        size += len(row.term)
        if size > limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def _first_lines(terms: list[str], lines: int):
    """For the terms that a task's texts hold, the first lines with them; a line counts once per term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for t in terms:
            machine.add_word(t, t)
        machine.make_automaton()
        best: dict[str, list[tuple[int, int, str]]] = {}
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if doc_id is None or not text:
                    continue
                ends = [i for i, c in enumerate(text) if c == "\n"] if "\n" in text else []
                for end, term in machine.iter(text.encode().lower().decode()):
                    found = best.setdefault(term, [])
                    at = (doc_id, bisect_right(ends, end))
                    if len(found) == lines and at >= found[-1][:2] or any(x[:2] == at for x in found):
                        continue
                    start = ends[at[1] - 1] + 1 if at[1] else 0
                    insort(found, (*at, text[start : ends[at[1]] if at[1] < len(ends) else len(text)]))
                    del found[lines:]
        rows = [(t, *x) for t, xs in best.items() for x in xs]
        if rows:
            term, doc, line, excerpt = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(doc, pa.int64()), pa.array(line, pa.int32()), pa.array(excerpt)], names=["term", "doc_id", "line", "excerpt"])

    return run


def search_questions(docs: DataFrame, questions: DataFrame, *, lines: int = 12, score: float = 0.7, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """For each question the first ``lines`` lines that ``exact_search`` gives: ``question_id, place, doc_id, line, locator, excerpt, score``.

    ``questions``: ``question_id, question``; ``docs``: ``doc_id, text`` with unique ids. A
    question's terms are its first eight, found anywhere in a line whatever the case of
    A to Z. All distinct terms are found in one pass over the texts (more passes beyond
    ``pass_bytes`` of terms). The first lines of a question are among the first lines of
    its terms, so a task sends that many per term, however often a term occurs.
    Questions without a hit and documents without an id give no rows.
    """
    asked = questions.select("question_id", F.explode(F.array_distinct(F.transform(F.slice(query_terms(F.col("question")), 1, TERMS), lambda t: F.lower(t)))).alias("term"))
    asked = written(asked, "asked")
    places = asked.groupBy("term").agg(F.count("*").alias("_n"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hits = None
    for terms in _passes(places.select("term"), pass_bytes):
        found = written(texts.mapInArrow(_first_lines(terms, lines), "term string, doc_id long, line int, excerpt string"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.limit(0).select(F.lit("").alias("term"), "doc_id", F.lit(0).alias("line"), F.lit("").alias("excerpt"))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("doc_id", "line"))
    hits = hits.withColumn("_k", first("term")).where(F.col("_k") <= lines)
    lists = hits.groupBy("term").agg(F.collect_list(F.struct("doc_id", "line", "excerpt")).alias("_hits"))  # ``lines`` at most
    joined = join_counted(asked, places.join(lists, "term"), "term", "_n", asked.count())
    rows = joined.select("question_id", F.explode("_hits").alias("h")).select("question_id", "h.*").dropDuplicates(["question_id", "doc_id", "line"])
    rows = rows.withColumn("place", first("question_id")).where(F.col("place") <= lines)
    return rows.select("question_id", "place", "doc_id", "line", F.concat_ws(":", "doc_id", F.col("line") + 1).alias("locator"), "excerpt", F.lit(score).alias("score"))
