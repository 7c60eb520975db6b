"""Spelling variants of the corpus vocabulary by Aho-Corasick halves.

Two words that differ by one inserted, deleted or replaced code point share a half: either the first half of
one begins the other, or its second half ends it.

1. Words and their counts are gathered by Spark's aggregates.
2. A word is dealt by each half that it has itself, and by each that a word one shorter, as long or one longer
   could share with it, to shards of some ten thousand halves. A half that more than GROUP words share is
   replaced by two longer ones (it and either half of what it leaves open), and so on, so that no shard holds
   an unbounded group.
3. A shard builds one automaton over the halves of its words and scans all words dealt to it. A hit counts
   where the half stands at the offset it has in its own word and the lengths differ by one at most; the rest is
   then held against the rests of all words with that half, through their variants with one code point
   missing, so a half costs no pairs but true ones.
4. A word's form is its most frequent near word, if ten times as frequent; counts rise tenfold along a chain
   of forms, so a few rounds of pointer jumping find its root.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Code points of a word at least, occurrences at least, and how much more frequent a form is.
LENGTH, OCCURRENCES, RATIO = 7, 2, 10
#: One occurrence in so many loses a code point.
THINNED = 31
LETTERS = r"A-Za-zÀ-ÿ"
#: Words that may share a half before it is replaced by longer ones, and halves in a shard, about.
GROUP, SHARD = 20_000, 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
FOUND_SQL = "word string, n_near long, form_n long, form string"


def vocabulary(docs: DataFrame) -> DataFrame:
    """Distinct words (word, n): maximal runs of letters, A-Z lower-cased, one code point gone where the
    checksum of document and run says so; LENGTH code points and OCCURRENCES at least. Shorter runs can
    give no word and are never taken out of the text. A null doc_id is written as nothing."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_or_empty(), F.lit(f"[{LETTERS}]{{{LENGTH},}}+"), F.lit(0))).alias("run"),
    )
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"), F.length("run").cast("long").alias("size"))
    at = (F.col("h") % F.col("size")).cast("int")
    thinned = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.col("size").cast("int")))
    words = hashed.select(F.when(F.col("h") % THINNED == 0, thinned).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURRENCES)


def _halved(a: Column, b: Column, m: Column, path: Column) -> Column:
    """The two ways to keep half of what lies between a leading and b trailing code points of a word of m."""
    half = F.floor((m - a - b) / 2).cast("int")
    first = F.struct(m.alias("m"), (a + half).alias("a"), b.alias("b"), F.concat(path, F.lit("p")).alias("path"))
    second = F.struct(m.alias("m"), a.alias("a"), (m - a - half).alias("b"), F.concat(path, F.lit("s")).alias("path"))
    return F.array(first, second)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: length of the word that is looked for, its leading a and trailing b code points."""
    tail = F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))
    return rows.withColumn("key", F.concat_ws("\0", F.col("m").cast("string"), F.substring("word", F.lit(1), F.col("a")), tail))


def halves(words: DataFrame, group: int) -> DataFrame:
    """Rows (word, n, m, a, b, path, key) by which words are dealt; those with m = length hold the word's own halves."""
    zero, size = F.lit(0), F.length("word")
    lengths = F.filter(F.array(size - 1, size, size + 1), lambda m: m >= LENGTH)
    parts = F.flatten(F.transform(lengths, lambda m: _halved(zero, zero, m, F.lit(""))))
    rows = _keyed(words.select("word", "n", F.explode(parts).alias("x")).select("word", "n", "x.*"))
    while True:  # each round halves what a half leaves open, so there are as many as a word's length has bits
        own = rows.filter((F.col("m") == F.length("word")) & (F.col("m") - F.col("a") - F.col("b") > 1))
        hot = materialize(own.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") > group).select("key"))
        if hot.isEmpty():
            return rows
        split = rows.join(hot, "key", "left_semi")
        parts = F.explode(_halved(F.col("a"), F.col("b"), F.col("m"), F.col("path"))).alias("x")
        finer = _keyed(split.select("word", "n", parts).select("word", "n", "x.*"))
        rows = materialize(rows.join(hot, "key", "left_anti").select(*finer.columns).unionByName(finer))


class Shard:
    """An automaton over halves, and for each half the rests of the words that have it."""

    def __init__(self, own: Iterable[tuple[str, int, int, int, str]]):
        import ahocorasick

        self.groups: dict[str, dict[tuple[int, int, int, str], tuple[dict[str, tuple], dict[str, list]]]] = defaultdict(dict)
        for word, n, a, b, path in own:
            m = len(word)
            whole, gaps = self.groups[word[m - b :] + "\0" + word[:a]].setdefault((m, a, b, path), ({}, defaultdict(list)))
            rest = word[a : m - b]
            whole[rest] = (n, word)
            for i in range(len(rest)):
                gaps[rest[:i] + rest[i + 1 :]].append((i, n, word))
        self.automaton = ahocorasick.Automaton()
        for half, held in self.groups.items():
            self.automaton.add_word(half, (half.index("\0"), held))
        if self.groups:
            self.automaton.make_automaton()

    @staticmethod
    def _earlier(word: str, other: str, path: str) -> bool:
        """Whether a half of ``word`` that comes before this one finds ``other`` too."""
        a, b, m = 0, 0, len(word)
        for step in path:
            half = (m - a - b) // 2
            if step == "p":
                a += half
            elif word[a : a + half] == other[a : a + half]:
                return True
            else:
                b = m - a - half
        return False

    def near(self, word: str) -> Iterator[tuple[int, str]]:
        """(n, word) of every word of the shard that is near ``word`` by a half held here, each pair once over all shards."""
        size = len(word)
        # second half, mark, first half: both ends of the word meet at the mark
        for end, (b, held) in self.automaton.iter(word + "\0" + word) if self.groups else ():
            if b > size:
                continue
            for (m, a, _, path), (whole, gaps) in held.items():
                if end != size + a or abs(m - size) > 1 or a + b > size:
                    continue
                rest = word[a : size - b]
                if m == size:
                    found = {(n, x) for i in range(len(rest)) for j, n, x in gaps.get(rest[:i] + rest[i + 1 :], ()) if j == i and x != word}
                elif m > size:
                    found = {x[1:] for x in gaps.get(rest, ())}
                else:
                    found = {whole[r] for r in {rest[:i] + rest[i + 1 :] for i in range(len(rest))} if r in whole}
                for n, other in found:
                    if "s" not in path or not self._earlier(other, word, path):
                        yield n, other


def _scan(batches: Iterator[pa.RecordBatch], rows_out: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, sorted by shard, then a shard's own halves before the words to scan."""
    now, own, shard, last, out = None, [], None, None, []
    for batch in batches:
        for number, path, word, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "word", "n", "a", "b")), strict=True):
            if number != now:
                now, own, shard, last = number, [], None, None
            if path is not None:
                own.append((word, n, a, b, path))
                continue
            if shard is None:
                shard, own = Shard(own), []
            if word == last:  # dealt here by several halves
                continue
            last = word
            count, best = 0, None
            for k, other in shard.near(word):
                count += 1
                if best is None or (-k, other) < best:
                    best = (-k, other)
            if count:
                out.append((word, count, -best[0], best[1]))
                if len(out) >= rows_out:
                    yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in out], FOUND)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in out], FOUND)


def near_words(words: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """word, n_near, form_n, form (the near word of largest n, then smallest) of every word that has near words.

    ``words`` is a written table of distinct (word, n).
    """
    rows = halves(words, group)
    count = words.count()
    shards = max(1, 2 * count // shard)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    own = dealt.filter(F.col("m") == F.length("word")).select("shard", "path", "word", "n", "a", "b")
    none = F.lit(None).cast("int")
    scanned = dealt.select("shard", F.lit(None).cast("string").alias("path"), "word", F.lit(None).cast("long").alias("n"), none.alias("a"), none.alias("b"))
    met = own.unionByName(scanned).repartition(shards, "shard").sortWithinPartitions("shard", F.col("path").isNull(), "word")
    found = met.mapInArrow(_scan, FOUND_SQL)
    best = F.min(F.struct((-F.col("form_n")).alias("k"), F.col("form").alias("w"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.k")).alias("form_n"), F.col("best.w").alias("form"))


def rooted(forms: DataFrame) -> DataFrame:
    """``forms`` (word, n, form, ...; a written table) with ``root``: follow the forms to the last.

    A form is RATIO times as frequent as its word, so a chain has as many links as the largest count has
    digits, and each round doubles the links that a pointer spans.
    """
    links = len(str(forms.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]))
    at = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(1, links - 1).bit_length()):
        at = materialize(at)
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return forms.join(at, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary (see :func:`vocabulary`).

    Null and empty texts have no words; repeated rows count again; ties between forms go to the smallest
    word in code-point order. An empty table gives an empty one, and further columns are not read.
    """
    words = materialize(vocabulary(docs))
    near = near_words(words, group, shard)
    taken = F.col("form_n") >= RATIO * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("form")).alias("form"), F.when(taken, F.col("form_n")).alias("form_n"),
    )
    return rooted(materialize(forms)).select("word", "form", "root", "n", "n_near", "form_n")


def op13(docs: DataFrame) -> DataFrame:
    """The digest rows are the operator's own; see :func:`variants`."""
    return variants(docs)


ORACLE = r"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]{7,}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM t GROUP BY ALL),
b AS (SELECT run, n, length(run) AS size, list_transform(range(length(x) // 2), lambda i: (instr('0123456789ABCDEF', substr(x, (2 * i + 1)::INT, 1)) - 1) * 16
    + instr('0123456789ABCDEF', substr(x, (2 * i + 2)::INT, 1)) - 1) AS bytes FROM r),
h AS (SELECT run, n, size, xor(list_reduce([4294967295] || range(8 * len(bytes)), lambda a, i: xor((CASE WHEN i % 8 = 0 THEN xor(a, bytes[i // 8 + 1]) ELSE a END) >> 1,
    3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(a, bytes[i // 8 + 1]) ELSE a END) & 1))), 4294967295) AS h FROM b),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % size)::INT) || substr(run, (h % size + 2)::INT) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n, length(word) AS size FROM c WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, (i + 2)::INT) AS gap FROM (SELECT *, unnest(range(size)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM g a JOIN g b ON a.gap = b.gap AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.gap = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.gap = w.word),
f AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS form, max(n) AS form_n FROM p GROUP BY word),
l AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.form_n >= 10 * w.n THEN f.form END AS form, CASE WHEN f.form_n >= 10 * w.n THEN f.form_n END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
c2 AS (SELECT word, word AS at FROM l UNION ALL SELECT c2.word, l.form FROM c2 JOIN l ON l.word = c2.at WHERE l.form IS NOT NULL),
e AS (SELECT c2.word, c2.at AS root FROM c2 JOIN l ON l.word = c2.at WHERE l.form IS NULL)
SELECT l.word, l.form, e.root, l.n::BIGINT AS n, l.n_near::BIGINT AS n_near, l.form_n::BIGINT AS form_n FROM l JOIN e ON e.word = l.word
"""
