"""Spelling variants: words one edit apart, found by a frontier that walks a trie of all words.

The trie is a table of edges dealt over the cluster; a node is the 64-bit hash of its
prefix together with the number of letters still to come.  The frontier holds states
(word, position, node, edits): a word starts on its own path with no edits, spends its one
edit (a letter left out, or another letter the node has before the same next letters), and
from then on every join with the edges must match.  The state carries hashes of the letters still to match.

* Edges come in strides of 1, 2, 4, … letters, and a state takes the longest stride that fits
  the letters left, so words of n letters need about log n levels, a word has one edge for
  each position, and the first level drops nearly all states that lead nowhere.
* Edits in the back half of a word are found in the trie of the words, edits in the front
  half in the trie of the reversed words.  So edits happen at deep nodes with few children
  only, and the top of the trie, which all words share, is never fanned out.
* Only deletions and rising replacements are followed; an insertion is a deletion seen
  from the other word, and every pair is turned round at the end.

Ends of paths are candidates: they are compared as words, so a clash of hashes adds nothing.

Defined cases: no words give an empty result; words that differ in case of letters beyond
A-Z are different; NULL words are left out; length does not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorumcast.llm.text_arrays import _powers, mix
from quorumcast.staging import join_by_measured_size, stage

#: A form must be this many times as frequent as the word.
FACTOR = 10
_BASE = 0xA24BAED4963EE407
_AT_ONCE = 1 << 17
#: Label of the edge that keeps a finished state where it is.
END = 0


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


class _Spans:
    """Hashes of spans of the words' letters, laid end to end."""

    def __init__(self, words: list[str], reverse: bool):
        self.straight = _Spans(words, False) if reverse else self
        if reverse:
            words = [w[::-1] for w in words]
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.letters = letters
        self.total = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(letters)), out=self.total[1:])
        self.down = _powers(pow(_BASE, -1, 1 << 64), len(letters) + 1)
        self.salt = np.uint64(0x5851F42D4C957F2D if reverse else 0)

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.total[b] - self.total[a]) * self.down[a] + (b - a).astype(np.uint64))

    def label(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (self.span(a, b) >> np.uint64(32)).astype(np.uint32)
        return np.where(h == END, 1, h).astype(np.uint32).view(np.int32)

    def node(self, first: np.ndarray, upto: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Node of the prefix up to a position, in the trie of words with ``left`` more letters.

        Where none is left the node is the word, which has the same number in both tries."""
        inside = mix(self.span(first, upto) + mix(left.astype(np.uint64) ^ self.salt))
        if self.straight is self:
            return inside.view(np.int64)
        word = np.searchsorted(self.first, first, "right") - 1
        # Of the reversed word the first letters; of the word itself the last ones.
        end = self.first[word] + self.lengths[word]
        whole = mix(self.straight.span(end - (upto - first), end) + mix(np.zeros(1, np.uint64)))
        return np.where(left == 0, whole, inside).view(np.int64)

    @staticmethod
    def stride(left: np.ndarray) -> np.ndarray:
        """The longest power of two of letters that fits; 0 for none."""
        return np.where(left > 0, 1 << np.frexp(left.astype(np.float64))[1].astype(np.int64) - 1, 0)

    def back_half(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and letters left for every position in the back half of a word."""
        word = np.repeat(np.arange(len(self.lengths)), self.lengths)
        at = np.arange(len(self.letters))
        kept = at - self.first[word] >= self.lengths[word] // 2
        word, at = word[kept], at[kept]
        return word, at, self.first[word] + self.lengths[word] - at


def _batches(batch: pa.RecordBatch):
    """Words of a batch in pieces of bounded size; a longer word stands alone."""
    piece, held = [], 0
    for w in batch.column("word").to_pylist():
        if piece and held + len(w) > _AT_ONCE:
            yield piece
            piece, held = [], 0
        piece.append(w)
        held += len(w)
    if piece:
        yield piece


def _mapped(words: DataFrame, rows, schema: str, sides: tuple[bool, ...] = (False, True)) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def kernel(batches):
        for batch in batches:
            for piece in _batches(batch):
                for reverse in sides:
                    yield pa.RecordBatch.from_arrays(rows(_Spans(piece, reverse), piece), names=names)

    return words.select("word").mapInArrow(kernel, schema)


def ends(words: DataFrame) -> DataFrame:
    """The node that is the word, for each word."""
    def rows(s, piece):
        return [pa.array(s.node(s.first, s.first + s.lengths, np.zeros(len(piece), np.int64))), pa.array(piece, pa.string())]

    return _mapped(words, rows, "node bigint, word string", (False,))


def _edge(node: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Node and label in one number; with the END label it is the node."""
    return node ^ (label.astype(np.int64) << 32)


def strides(words: DataFrame) -> DataFrame:
    """Edges of 1, 2, 4, … letters: ``edge`` (node and label), ``child``; and one at each end that stays there."""
    def rows(s, _):
        word, at, left = s.back_half()
        step = s.stride(left)
        return [pa.array(_edge(s.node(s.first[word], at, left), s.label(at, at + step))), pa.array(s.node(s.first[word], at + step, left - step))]

    steps = _mapped(words, rows, "edge bigint, child bigint")
    stay = ends(words).select(F.col("node").alias("edge"), F.col("node").alias("child"))
    # Said for all readers, or each would be given a filter and a shuffle of its own.
    return steps.union(stay).filter("edge IS NOT NULL AND child IS NOT NULL").repartition("edge").distinct()


def frontier(words: DataFrame) -> DataFrame:
    """States about to spend their edit on the next letter: ``word`` (the node at its end), ``edge`` (its node, and the label of
    the stride after the letter), ``letter``, ``child`` (the node after that stride), ``shorter`` (the edge if the
    letter is left out), ``rest`` (labels of the strides after the first)."""
    def rows(s, _):
        word, at, left = s.back_half()
        first, end = s.first[word], s.first[word] + s.lengths[word]
        after, n = at + 1, left - 1
        step = s.stride(n)
        label, child = np.where(n > 0, s.label(after, after + step), END).astype(np.int32), s.node(first, after + step, n - step)
        edge, shorter = _edge(s.node(first, at, left), label), _edge(s.node(first, at, n), label)
        after, n = after + step, n - step
        bits = max(1, int(n.max(initial=0)).bit_length())
        labels, there = np.zeros((len(at), bits), np.int32), np.zeros((len(at), bits), bool)
        for k in range(bits):  # the longest stride first
            some = np.flatnonzero(n >> (bits - 1 - k) & 1)
            there[some, k] = True
            labels[some, k] = s.label(after[some], after[some] + (1 << (bits - 1 - k)))
            after[some] += 1 << (bits - 1 - k)
        offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        return [pa.array(s.node(first, end, np.zeros(len(at), np.int64))), pa.array(edge), pa.array(s.letters[at].astype(np.int32)),
                pa.array(child), pa.array(shorter), pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels[there]))]

    return _mapped(words, rows, "word bigint, edge bigint, letter int, child bigint, shorter bigint, rest array<int>")


def neighbours(words: DataFrame, *more: str) -> DataFrame:
    """Pairs of words exactly one inserted, deleted or replaced letter apart, one way round: ``word_a``, ``word_b`` and
    the columns ``more`` of both.  ``words`` has no repeats; it is read several times."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    start, edges = frontier(words), strides(words)
    # The other letters a node has before the same stride: one for each letter and next node, however many words go through.
    others = start.select("word", "edge", "letter", "child", "rest").withColumn(
        "others", F.collect_set(F.struct("letter", "child")).over(Window.partitionBy("edge")))
    replaced = others.select("word", F.explode(F.filter("others", lambda o: o["letter"] > F.col("letter"))).alias("o"), "rest") \
        .select("word", F.col("o.child").alias("node"), "rest")
    deleted = start.select("word", F.col("shorter").alias("edge"), "rest").join(edges, "edge").select("word", F.col("child").alias("node"), "rest")
    states = deleted.union(replaced)
    for _ in range((-(-longest // 2)).bit_length()):
        label = F.coalesce(F.get("rest", F.lit(0)), F.lit(END)).cast("bigint")
        states = states.select("word", F.col("node").bitwiseXOR(F.call_function("shiftleft", label, F.lit(32))).alias("edge"),
                               F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest")) \
            .join(edges, "edge").select("word", F.col("child").alias("node"), "rest")
    pairs = states.filter("word <> node").select(F.least("word", "node").alias("a"), F.greatest("word", "node").alias("b")).distinct()
    known = ends(words).join(words.select("word", *more), "word") if more else ends(words)
    one, other = (known.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("word", *more)]) for x in "ab")
    return pairs.join(one, "a").join(other, "b").filter(F.levenshtein("word_a", "word_b", 1) == 1).drop("a", "b")


def group_variants(counts: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for a table of ``word`` and ``n``.

    A word's form is its most frequent neighbour (ties: the smallest), if that is ``factor`` times as
    frequent; its root is where the forms lead.  Each form is more frequent than the word, so forms
    end; a step of the walk is one join with the table of forms, which the shared folder holds.
    """
    join_by_measured_size(counts.sparkSession)  # staged words unpack to many times their files
    counts = counts.filter("word IS NOT NULL").select("word", "n")
    near = neighbours(counts, "n")
    sides = [F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("word", "n")]) for x in "ab"]
    ways = near.select(F.explode(F.array(F.struct(sides[0].alias("own"), sides[1].alias("near")), F.struct(sides[1].alias("own"), sides[0].alias("near")))).alias("way"))
    best = ways.groupBy(F.col("way.own.word").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("way.near.n")).alias("less"), F.col("way.near.word").alias("form"))).alias("best"))
    known = counts.join(best, "word", "left")
    form = F.when(-F.col("best.less") >= F.lit(factor) * F.col("n"), F.col("best.form"))
    known = stage(known.select("word", "n", form.alias("form"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
                               F.when(form.isNotNull(), -F.col("best.less")).alias("form_n")), "spelling-forms")
    forms = known.filter("form IS NOT NULL").select("word", "form")
    following = forms.select(F.col("word").alias("at"), F.col("form").alias("next"))
    walk = forms.select("word", F.col("form").alias("at"))
    arrived = None
    while True:
        step = stage(walk.join(following, "at", "left"), "spelling-walk")
        done = step.filter("next IS NULL").select("word", F.col("at").alias("root"))
        arrived = done if arrived is None else arrived.union(done)
        walk = step.filter("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if walk.isEmpty():
            break
    return known.join(arrived, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, least_letters: int = 7, least_count: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of Latin letters with A-Z in lower case, of ``least_letters`` at least, that
    occur ``least_count`` times.  In one of 31 runs (by a hash of document and run) a letter is dropped,
    which plants spelling variants.  A NULL id counts as an empty one."""
    # Runs of fewer letters cannot give a word: the pattern still finds whole runs only.
    run = F.explode(F.regexp_extract_all(text, F.lit("[A-Za-zÀ-ÿ]{%d,}" % least_letters), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    dropped = F.overlay("run", F.lit(""), (F.col("h") % F.length("run")).cast("int") + 1, F.lit(1))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, dropped).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)
