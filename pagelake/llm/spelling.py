"""Spelling variants of a vocabulary (operator 11).

All pairs of words that differ by one edit come from a composition of finite-state
machines: the minimised acceptor of the vocabulary, a transducer that makes exactly one
edit, and the acceptor again. Before the edit both sides read the same symbols, so the
composition is cut by what its words have read: a partition holds the words that agree
in everything before and after a region of places, and only edits inside this region
are made there. The regions of a word are its halves at first; a partition that has
more words than a task should hold is cut into halves again, at last into single places,
where it has no more words than the alphabet has pairs of letters.
"""

from __future__ import annotations

import itertools
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import Tables, join_counted, text_chunks

#: Fixed values of the production run: one run in ``BLUR`` loses a letter.
BLUR, SHORTEST, LEAST, RATIO = 199, 6, 5, 5
#: Words of one partition of the composition, and places of its region.
GROUP, REGION = 4096, 32
#: Words that a task counts before it sends them on, and rows of a batch.
TABLE_WORDS, ROWS = 400_000, 20_000

#: Letters in Latin-1: A-Z become a-z, whatever is in no word becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, blur: int | None = BLUR) -> DataFrame:
    """``word, n``: words of ``shortest`` letters or more that all texts have ``least`` times or more.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z in lower case. With ``blur``,
    a run loses one letter where ``blur`` divides the crc32 of ``<doc_id>:<run>`` (a null
    id: nothing before the colon). Null and empty texts have no words, repeated rows count
    each time, and a very long word is a word like others. Columns other than these two
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batch(total: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in total]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in text_chunks(batches, "text"):
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                # letters of the words are single bytes in Latin-1; all other characters end a word
                words = Counter(w for w in text.encode("latin-1", "replace").translate(_FOLD).split() if len(w) >= shortest)
                start = zlib.crc32(b":" if i is None else b"%d:" % i)
                for w, n in words.items():
                    if blur:
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % blur == 0:
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                            if len(w) < shortest:
                                continue
                    total[w] += n
            if len(total) > TABLE_WORDS:
                yield batch(total)
                total = Counter()
        if total:
            yield batch(total)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Acceptors:
    """Minimised acceptors over one pool of states: states that accept the same endings are one."""

    def __init__(self):
        self.edges: list[dict[str, int]] = [{}]  # state 0 accepts the empty ending
        self.known: dict[tuple, int] = {(): 0}
        self.shared: dict[tuple[int, int], list[str]] = {(0, 0): [""]}

    def add(self, words: list[str]) -> int:
        """First state of the acceptor of sorted, distinct words of one length."""
        size = len(words[0])

        def state(lo: int, hi: int, depth: int) -> int:
            if depth == size:
                return 0
            edges = []
            while lo < hi:
                c, at = words[lo][depth], lo + 1
                while at < hi and words[at][depth] == c:
                    at += 1
                edges.append((c, state(lo, at, depth + 1)))
                lo = at
            found = self.known.setdefault(tuple(edges), len(self.edges))
            if found == len(self.edges):
                self.edges.append(dict(edges))
            return found

        return state(0, len(words), 0)

    def endings(self, p: int, q: int) -> list[str]:
        """Endings that both states accept: the composition after its edit."""
        found = self.shared.get((p, q))
        if found is None:
            other = self.edges[q]
            found = [c + e for c, r in self.edges[p].items() if c in other for e in self.endings(r, other[c])]
            self.shared[p, q] = self.shared[q, p] = found
        return found

    def replaced(self, p: int, made: dict[int, list]) -> list[tuple[str, str]]:
        """Pairs of endings of a state that differ in one symbol, each once."""
        if p not in made:
            out = self.edges[p]
            made[p] = [(x + e, y + e) for (x, r), (y, s) in itertools.combinations(out.items(), 2) for e in self.endings(r, s)]
            made[p] += [(x + u, x + v) for x, r in out.items() for u, v in self.replaced(r, made)]
        return made[p]

    def inserted(self, p: int, q: int, last: bool, made: dict[tuple[int, int], list]) -> list[tuple[str, str]]:
        """Endings of ``p`` beside those of ``q`` that have one symbol more, each pair once.

        The symbol counts as inserted where the endings first differ; after the last
        symbol of the region only if the word ends there.
        """
        if (p, q) not in made:
            mine, out = self.edges[p], self.edges[q]
            pairs = [(e, y + e) for y, s in out.items() for e in self.endings(p, s) if (e[0] != y if e else last)]
            made[p, q] = pairs + [(x + u, x + v) for x, r in mine.items() if x in out for u, v in self.inserted(r, out[x], last, made)]
        return made[p, q]


def _pairs(short: list[str], long: list[str], last: bool) -> Iterator[tuple[str, str]]:
    """One edit apart: two of ``short`` (one symbol replaced) or one of each (one inserted)."""
    pool = Acceptors()
    first = pool.add(sorted(short))
    yield from pool.replaced(first, {})
    if long:
        yield from pool.inserted(first, pool.add(sorted(long)), last, {})


def _compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per partition and word: number of near words and the best of them."""
    names = ["key", "size", "a", "b", "long", "word", "n"]
    rows = itertools.chain.from_iterable(zip(*[b.column(c).to_pylist() for c in names]) for b in batches)
    made: list[tuple] = []

    def flush() -> pa.RecordBatch:
        word, number, n, near = zip(*made)
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(number, pa.int64()), pa.array(n, pa.int64()), pa.array(near, pa.string())], names=["word", "n_near", "near_n", "near"])

    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        exact: dict[tuple, tuple[dict, dict]] = {}  # the key is a hash: words must agree themselves
        for _, size, a, b, long, word, n in group:
            end = b + 1 if long else b
            sides = exact.setdefault((size, a, b, word[:a], word[end:]), ({}, {}))
            sides[long][word[a:end]] = (word, n)
        for (size, _, b, _, _), (short, long) in exact.items():
            if not short or len(short) + len(long) < 2:
                continue
            best: dict[str, list] = {}
            for u, v in _pairs(list(short), list(long), b > size):
                one, other = short[u], short.get(v) or long[v]
                for (word, _), (near, n) in ((one, other), (other, one)):
                    has = best.get(word)
                    if has is None:
                        best[word] = [1, n, near]
                    else:
                        has[0] += 1
                        if (-n, near) < (-has[1], has[2]):
                            has[1:] = n, near
            made += [(w, *x) for w, x in best.items()]
            if len(made) > ROWS:
                yield flush()
    if made:
        yield flush()


def _regions(rows: DataFrame, *cuts: tuple[Column, Column]) -> DataFrame:
    """Rows in the given regions of places, with a key of what lies outside the region."""
    outside = [F.expr("left(word, a)"), F.expr("substr(word, b + 1 + cast(long AS int))")]
    cut = rows.withColumn("_r", F.explode(F.array(*[F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")) for a, b in cuts])))
    cut = cut.select("word", "n", "size", "long", "_r.a", "_r.b")
    return cut.withColumn("key", F.xxhash64("size", "a", "b", *outside))


def near_words(words: DataFrame, *, tables: Tables | None = None, group: int = GROUP, region: int = REGION) -> DataFrame:
    """``word, n_near, near, near_n`` of each word that has near words: their number and the best one.

    ``words`` (word, n) are distinct and not null. Two words are near if one symbol is
    inserted, deleted or replaced. The best near word has the largest ``n``, ties go to
    the first in code-point order. A word of L symbols meets others of L symbols and of
    L + 1 ones; rows of partitions with one word end at the count.
    """
    tables = tables or Tables(words.sparkSession, "spelling")
    size = F.length("word")
    roles = F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("long")), F.struct((size - 1).alias("size"), F.lit(True).alias("long"))))
    rows = words.select("word", "n", roles.alias("_x")).select("word", "n", "_x.*").where("size > 0")
    middle = F.floor((F.col("size") + 1) / 2)
    rows = _regions(rows, (F.lit(0), middle), (middle, F.col("size") + 1))
    ready, level = [], 0
    while True:
        rows = tables.write(rows, f"rows-{level}")
        counts = tables.write(rows.groupBy("key").agg(F.count("*").alias("_n"), F.count_if(~F.col("long")).alias("_short")).where("_n > 1 AND _short > 0"), f"counts-{level}")
        total = counts.agg(F.sum("_n")).first()[0] or 0
        several = tables.write(join_counted(rows, counts.select("key", "_n"), "key", "_n", total), f"several-{level}")
        width = F.col("b") - F.col("a")
        large = ((F.col("_n") > group) | (width > region)) & (width > 1)
        ready.append(several.where(~large).drop("_n"))
        if not level:
            tables.drop("rows-0", "counts-0")
        rest = several.where(large).drop("_n")
        if rest.isEmpty():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2)
        rows, level = _regions(rest, (F.col("a"), middle), (middle, F.col("b"))), level + 1
    all_rows = ready[0]
    for more in ready[1:]:
        all_rows = all_rows.unionByName(more)
    found = all_rows.repartition("key").sortWithinPartitions("key").mapInArrow(_compose, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_best")).select("word", "n_near", "_best.near", (-F.col("_best.k")).alias("near_n"))


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, group: int = GROUP, region: int = REGION) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each of ``words`` (word, n; distinct).

    The form is the best near word if it is ``ratio`` times as frequent or more, else
    null; the root is what following the forms ends at, the word itself without a form.
    Rows with a null word are left out; no words give no rows. Forms get ever more
    frequent, so following them doubles its step in each round and ends soon.
    """
    tables = Tables(words.sparkSession, "spelling")
    words = tables.write(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL"), "words")
    scratch = Tables(words.sparkSession, "spelling-near")
    near = near_words(words, tables=scratch, group=group, region=region)
    formed = F.col("near_n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")
    )
    judged = tables.write(judged, "judged")
    tables.drop("words")
    scratch.clear()
    steps = tables.write(judged.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "steps-0")
    for k in itertools.count(1):
        on = steps.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        steps = tables.write(steps.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), f"steps-{k}")
        tables.drop(f"steps-{k - 1}")
        if steps.where("moved").isEmpty():
            break
    return judged.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", blur: int | None = BLUR) -> DataFrame:
    """``spelling_variants`` of the words of all texts."""
    return spelling_variants(word_counts(docs, id_col=id_col, text_col=text_col, blur=blur))
