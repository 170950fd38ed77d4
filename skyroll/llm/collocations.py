"""Phrase collocations from a weighted de Bruijn graph of the texts' words.

Nodes are word sequences of ``longest - 1`` words, an edge is one of ``longest``
words between two nodes that overlap, and its weight the times it occurs. Only
these longest sequences are gathered from the texts, beside one row for each
shorter sequence that ends a piece. All else follows from the graph: a node
occurs as often as its edges leave it plus the pieces that end in it, and a
shorter sequence as often as the longer ones that it begins plus the pieces
that end in it. Frequent edges are kept as unary paths: where all occurrences
of a node come by one edge and leave by one, both edges are one path, and the
node's count is the weight of the path.

Edges are counted in each task before they are dealt out by their node, so one
shuffle gives edges and nodes, and a frequent node costs a row for each
different successor and task, not one for each occurrence. A first pass counts
words. A word that is rarer than a candidate is in none, so all such words of a
language are one id, and the others get ids of their own; an edge is then one
number. The words are sent to the tasks for that while there are at most
``WORDS_SENT`` of them; beyond that, edges are counted as texts. Both ways give
the same graph.

Defined cases: a null text has no words; a null language is ``und``; repeated
rows count each time; an empty table gives no rows; extra columns are ignored;
an edge on a cycle of unary nodes is a path of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyroll.llm.common import documents, saved, small_batches

LONGEST = 3              # words of the longest phrase
LEAST_COUNT = 10         # occurrences of a candidate
SHADOW_PERCENT = 50      # share of a candidate inside a longer one that drops it
TOP = 2000               # phrases of each language
SCALE = 1_000_000        # units of a score of one
BLOCK_EDGES = 256        # edges in a row of a path; longer paths take several rows
TALLY = 400_000          # different words or edges that a task counts before it hands them on
WORDS_SENT = 1_000_000   # words that are sent to every task
IDS_AT_ONCE = 4_000_000  # words whose edges a task counts at a time

# Lower-cases A-Z, makes blanks of tabs and, of what ends a piece, a byte that no
# UTF-8 text holds.
_END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t",
                        b"abcdefghijklmnopqrstuvwxyz" + 10 * _END + b" ")

# ``key`` is the language, a tab and the words of a node; no word holds a tab.
_TALLY = pa.schema([("key", pa.string()), ("tail", pa.string()), ("w", pa.int64())])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """(language, folded text) of each row."""
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
        yield lang.encode(), text.encode().translate(_FOLD)


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return (docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
            .where(F.col("text").isNotNull()))


def frequent_words(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(lang, word), saved: words that occur ``least`` times in their language, and
    for each language the word ''."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lang: dict[bytes, Counter] = {}

        def handed() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in of_lang.items() for w, n in c.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()),
                 pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in _rows(batch):
                if lang not in of_lang:
                    of_lang[lang] = Counter({b"": least})
                of_lang[lang].update(text.replace(_END, b" ").split())
            if sum(map(len, of_lang.values())) >= TALLY:
                yield handed()
                of_lang = {}
        yield handed()

    return saved(_texts(docs).mapInArrow(count, "lang string, word string, n long")
                 .groupBy("lang", "word").agg(F.sum("n").alias("n"))
                 .where(F.col("n") >= least).select("lang", "word"), "frequent-words")


def edge_texts(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, tail, w): occurrences of edges, counted within tasks. ``tail`` is the
    word that follows the node, or '' where a piece ends in ``key`` (of fewer words
    too)."""
    def handed(of_lang: dict[bytes, Counter]) -> pa.RecordBatch:
        grams = [(lang, g, n) for lang, c in of_lang.items() for g, n in c.items()]
        out = pa.Table.from_arrays(
            [pa.array([lang + b"\t" + b" ".join(g[:-1]) for lang, g, _ in grams], pa.string()),
             pa.array([g[-1] for _, g, _ in grams], pa.string()),
             pa.array([n for _, _, n in grams], pa.int64())], schema=_TALLY)
        # neighbours with one key shrink well in the shuffle's compression
        return out.sort_by("key").combine_chunks().to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_lang: dict[bytes, Counter] = {}
        held = 0
        for batch in batches:
            for lang, text in _rows(batch):
                tally = of_lang.setdefault(lang, Counter())
                before = len(tally)
                for piece in text.split(_END):
                    words = piece.split()
                    tally.update(zip(*[words[i:] for i in range(longest)]))
                    for size in range(1, min(longest - 1, len(words)) + 1):
                        tally[(*words[len(words) - size:], b"")] += 1
                held += len(tally) - before
                if held >= TALLY:
                    yield handed(of_lang)
                    of_lang, held = {}, 0
        if held:
            yield handed(of_lang)

    return _texts(docs).mapInArrow(count, "key string, tail string, w long")


def _sums_of_texts(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """(key, tail, w) of ``graph``, counted as texts."""
    rows = edge_texts(docs, longest).repartition(F.col("key"))
    edges = rows.groupBy("key", "tail").agg(F.sum("w").alias("w"))
    frequent = (F.col("w") >= least) & (F.col("tail") != "")
    both = edges.select("key", F.col("w"), F.explode(
        F.when(frequent, F.array("tail", F.lit(None))).otherwise(F.array(F.lit(None)))).alias("tail"))
    sums = both.groupBy("key", "tail").agg(F.sum("w").alias("w"))
    rare = F.lit(longest > 2) & (F.col("w") < least) & (F.size(_words("key")) == longest - 1)
    return (sums.withColumn("key", F.when(rare, _without_last("key")).otherwise(F.col("key")))
            .groupBy("key", "tail").agg(F.sum("w").alias("w")))


def _sums_of_ids(docs: DataFrame, words: pd.DataFrame, longest: int, least: int) -> DataFrame:
    """The same, counted as numbers: the ids of an edge's words, ``bits`` each. Id 0 is
    the end of a piece; the first ids are the languages' rare words (the word '')."""
    bits = 63 // longest
    words = words.sort_values(["word", "lang"], kind="stable")
    rare_ids = int((words["word"] == "").sum())
    names = [(lang, word) for lang, word in zip(words["lang"], words["word"])]
    sent = docs.sparkSession.sparkContext.broadcast(names)
    known: dict[bytes, dict[bytes, int]] = {}      # filled once in each Python worker

    def ids_of(lang: bytes) -> tuple[dict[bytes, int], int]:
        if not known:
            for i, (name, word) in enumerate(sent.value, start=1):
                known.setdefault(name.encode(), {_END: 0})[word.encode()] = i
        own = known[lang]
        return own, own[b""]

    def tallied(parts: list[np.ndarray]) -> pa.RecordBatch:
        s = np.concatenate(parts)
        grams, head = [], np.zeros(len(s), dtype=np.int64)
        whole = np.ones(len(s), dtype=bool)
        for size in range(1, longest):               # ``size`` words from each place on
            word = s[size - 1:]
            head = (head[:len(word) - 1] << bits) | word[:-1]
            whole = whole[:len(word) - 1] & (word[:-1] > 0)
            tail = s[size:]
            keep = whole if size == longest - 1 else whole & (tail == 0)
            grams.append((head[keep] << bits) | tail[keep])
        gram, count = np.unique(np.concatenate(grams), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(count)], ["gram", "w"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lang, text in _rows(batch):
                own, rare = ids_of(lang)
                tokens = text.replace(_END, b" \xff ").split()
                of = own.get
                held.append(np.array([of(t, rare) for t in tokens] + [0], dtype=np.int64))
                size += len(tokens) + 1
                if size >= IDS_AT_ONCE:
                    yield tallied(held)
                    held, size = [], 0
        if held:
            yield tallied(held)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, mask = sent.value, (1 << bits) - 1
        for b in batches:
            keys, tails = [], []
            for head, tail in zip(b.column("head").to_pylist(), b.column("tail").to_pylist()):
                own = []
                while head:
                    lang, word = every[(head & mask) - 1]
                    own.append(word)
                    head >>= bits
                keys.append(lang + "\t" + " ".join(reversed(own)))
                tails.append(None if tail < 0 else every[tail - 1][1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(tails, pa.string()), b.column("w")],
                schema=_TALLY)

    mask = (1 << bits) - 1
    rows = (_texts(docs).mapInArrow(count, "gram long, w long")
            .select(F.expr(f"shiftright(gram, {bits})").alias("head"),
                    F.expr(f"gram & {mask}L").alias("tail"), "w").repartition(F.col("head")))
    edges = rows.groupBy("head", "tail").agg(F.sum("w").alias("w"))
    ids = [F.expr(f"shiftright(head, {bits * k}) & {mask}L") for k in range(longest - 1)]
    full = ids[-1] > 0                               # a node, not a shorter end of a piece
    common = full
    for i in ids:
        common = common & (i > rare_ids)
    frequent = common & (F.col("tail") > rare_ids) & (F.col("w") >= least)
    flow = F.lit(-1).cast("long")
    both = edges.select("head", "w", F.explode(
        F.when(frequent, F.array("tail", flow)).otherwise(F.array(flow))).alias("tail"))
    sums = both.groupBy("head", "tail").agg(F.sum("w").alias("w"))
    rare = F.lit(longest > 2) & full & (~common | (F.col("w") < least))
    return (sums.withColumn("head", F.when(rare, F.expr(f"shiftright(head, {bits})"))
                            .otherwise(F.col("head")))
            .groupBy("head", "tail").agg(F.sum("w").alias("w"))
            .mapInArrow(named, "key string, tail string, w long"))


def _words(key: str | Column) -> Column:
    return F.split(F.substring_index(key, "\t", -1), " ")


def _lang(key: str) -> Column:
    """The language of a key: all before its last tab."""
    return F.expr(f"left({key}, length({key}) - 1 - length(substring_index({key}, '\\t', -1)))")


def _without_last(key: str) -> Column:
    """The key of the sequence without its last word (of two words at least)."""
    return F.expr(f"left({key}, length({key}) - 1 - length(substring_index({key}, ' ', -1)))")


def _tail_node(longest: int) -> Column:
    """The key of the node that an edge (key, tail) leads to."""
    return F.concat(_lang("key"), F.lit("\t"), F.array_join(
        F.slice(F.concat(_words("key"), F.array("tail")), 2, longest - 1), " "))


def graph(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT,
          words_sent: int = WORDS_SENT) -> DataFrame:
    """(key, tail, w), saved: the edges with a weight of ``least`` or more and, with a
    null tail, the flow out of every node with as much (piece ends included). Nodes with
    less are one flow of the sequence without their last word. Rare words may be ''."""
    words = frequent_words(docs, least)
    count = words.count()
    if count <= words_sent and count < 1 << (63 // longest):
        sums = _sums_of_ids(docs, words.toPandas(), longest, least)
    else:
        sums = _sums_of_texts(docs, longest, least)
    return saved(sums, "word-graph")


def shorter_counts(word_graph: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, words, n): counts of the sequences of 1 to ``longest - 1`` words (those of
    the frequent ones are whole), from the flow of the nodes and, size by size
    downwards, the pieces' ends."""
    flow = (word_graph.where(F.col("tail").isNull())
            .select("key", F.size(_words("key")).alias("words"), F.col("w").alias("n")))
    level = flow.where(F.col("words") == longest - 1)
    out = level
    for size in range(longest - 2, 0, -1):
        begun = level.select(_without_last("key").alias("key"), F.lit(size).alias("words"), "n")
        level = (begun.unionByName(flow.where(F.col("words") == size))
                 .groupBy("key", "words").agg(F.sum("n").alias("n")))
        out = out.unionByName(level)
    return out


def unary_paths(word_graph: DataFrame, least: int = LEAST_COUNT,
                longest: int = LONGEST) -> DataFrame:
    """(key, tails, w): the frequent edges as paths. Words of ``key`` and then
    ``tails`` in order; each edge is in one path, and all edges of a path weigh w.
    A node inside a path occurs w times and in no other place.

    Edges find their path's first edge by pointer doubling, with as many rounds as
    the longest path has binary digits; a round that finds no more leaves cycles."""
    nodes = (word_graph.where(F.col("tail").isNull() & (F.col("w") >= least))
             .select("key", F.col("w").alias("f")))
    edges = saved(word_graph.where(F.col("tail").isNotNull()).join(nodes, "key")
                  .select("key", "tail", "w", (F.col("w") == F.col("f")).alias("whole"),
                          F.concat_ws(" ", "key", "tail").alias("edge"),
                          _tail_node(longest).alias("next")), "frequent-edges")
    # e1 -> e2: e1 brings, and e2 takes, all that passes the node between them
    links = (edges.select(F.col("edge").alias("prev"), F.col("next").alias("node"), "w")
             .join(edges.where("whole").select(F.col("key").alias("node"), "edge", "w"),
                   ["node", "w"]).where(F.col("prev") != F.col("edge"))
             .select("edge", "prev"))
    jumps = saved(links.select("edge", F.col("prev").alias("at"), F.lit(1).alias("steps")),
                  "path-links")
    left, turn = jumps.count(), 0
    while left:
        turn += 1
        far = jumps.select(F.col("edge").alias("at"), F.col("at").alias("on"),
                           F.col("steps").alias("more"))
        jumps = saved(jumps.join(far, "at", "left").select(
            "edge", F.coalesce("on", "at").alias("at"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), f"path-{turn}")
        # an edge has arrived where its pointer has no link of its own
        rest = jumps.join(jumps.select(F.col("edge").alias("at")), "at", "left_semi").count()
        if rest == left:
            break
        left = rest
    cyclic = jumps.join(jumps.select(F.col("edge").alias("at")), "at", "left_semi")
    arrived = jumps.join(cyclic.select("edge"), "edge", "left_anti") if left else jumps
    placed = (edges.join(arrived, "edge", "left")
              .select(F.coalesce("at", "edge").alias("first"),
                      F.coalesce("steps", F.lit(0)).alias("step"), "key", "tail", "w"))
    run = F.sort_array(F.collect_list(F.struct("step", "key", "tail")))
    return (placed.groupBy("first", F.expr(f"step div {BLOCK_EDGES}").alias("block"))
            .agg(run.alias("run"), F.max("w").alias("w"))
            .select(F.col("run")[0]["key"].alias("key"), F.col("run.tail").alias("tails"), "w"))


def path_counts(paths: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(key, words, n, inner): the longest sequences of each path, and with ``inner``
    the nodes inside it, whose flow is the path's weight."""
    words = F.concat(_words("key"), "tails")
    cut = paths.select(_lang("key").alias("lang"), words.alias("all"), "w").select(
        "lang", "w", "all",
        F.explode(F.sequence(F.lit(1), F.size("all") - (longest - 1))).alias("at"))

    def gram(size: int) -> Column:
        return F.concat("lang", F.lit("\t"), F.array_join(F.slice("all", F.col("at"), size), " "))

    whole = cut.select(gram(longest).alias("key"), F.lit(longest).alias("words"),
                       F.col("w").alias("n"), F.lit(False).alias("inner"))
    inner = cut.where(F.col("at") > 1).select(
        gram(longest - 1).alias("key"), F.lit(longest - 1).alias("words"),
        F.col("w").alias("n"), F.lit(True).alias("inner"))
    return whole.unionByName(inner)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT,
                  words_sent: int = WORDS_SENT) -> tuple[DataFrame, DataFrame]:
    """(counts, totals), saved: (key, words, n) of every sequence of up to ``longest``
    words that occurs ``least`` times, and (lang, n) with all words of a language."""
    net = graph(docs, longest, least, words_sent)
    short = saved(shorter_counts(net, longest), "shorter-counts")
    along = saved(path_counts(unary_paths(net, least, longest), longest), "path-counts")
    # nodes inside a path count as the path does; the others by their own flow
    branching = (short.where(F.col("n") >= least)
                 .where(~F.array_contains(_words("key"), ""))
                 .join(along.where("inner").select("key"), "key", "left_anti"))
    counts = saved(branching.unionByName(along.drop("inner")), "phrase-counts")
    totals = saved(short.where(F.col("words") == 1).groupBy(_lang("key").alias("lang"))
                   .agg(F.sum("n").alias("n")), "word-totals")
    return counts, totals


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST_COUNT,
                 shadow_percent: int = SHADOW_PERCENT, top: int = TOP,
                 words_sent: int = WORDS_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases."""
    counts, totals = phrase_counts(docs, longest, least, words_sent)
    phrases = counts.where(F.col("words") > 1)
    # A sequence of more words occurs no more often than one of its parts, so of the
    # longer candidates only those with one word more need a look.
    longer = phrases.where(F.col("words") > 2).select(
        F.explode(F.array(_without_last("key"), F.concat(_lang("key"), F.lit("\t"), F.array_join(
            F.slice(_words("key"), 2, longest), " ")))).alias("key"), F.col("n").alias("above"))
    best = longer.groupBy("key").agg(F.max("above").alias("above"))
    kept = (phrases.join(best, "key", "left")
            .where(F.coalesce(100 * F.col("above") < shadow_percent * F.col("n"), F.lit(True)))
            .select("key", F.col("n").alias("a"), _words("key").alias("w"),
                    _lang("key").alias("lang")))
    cuts = kept.select("key", "lang", "a", "w",
                       F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))

    def part(words: Column) -> Column:
        return F.concat("lang", F.lit("\t"), F.array_join(words, " "))

    cuts = cuts.select("key", "lang", "a", "k", part(F.slice("w", 1, F.col("k"))).alias("front"),
                       part(F.slice("w", F.col("k") + 1, F.size("w"))).alias("back"))
    scored = (cuts.join(counts.select(F.col("key").alias("front"), F.col("n").alias("l")), "front")
              .join(counts.select(F.col("key").alias("back"), F.col("n").alias("r")), "back")
              # products of counts pass 64 bits; decimals of up to 38 digits hold them
              .withColumn("score", F.expr(
                  f"(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * {SCALE}BD) "
                  "div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))")))
    lowest = (scored.groupBy("key", "lang", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
              .select("lang", F.substring_index("key", "\t", -1).alias("phrase"), "a",
                      "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = (lowest.withColumn("rank", F.row_number().over(order).cast("long"))
              .where(F.col("rank") <= top))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


ORACLE_OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM pieces),
grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(generate_series(1, len(w) - 1),
    lambda i: array_to_string(w[i:i + 1], ' '))) FROM p WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(generate_series(1, len(w) - 2),
    lambda i: array_to_string(w[i:i + 2], ' '))) FROM p WHERE len(w) >= 3),
c AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
cand AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w
  FROM c WHERE words > 1 AND f >= 10),
shadowed AS (
  SELECT DISTINCT s.lang, s.phrase FROM cand s JOIN (
    SELECT lang, array_to_string(w[1:2], ' ') AS part, a FROM cand WHERE words = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE words = 3) t
  ON s.lang = t.lang AND s.phrase = t.part WHERE 100 * t.a >= 50 * s.a),
cuts AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS front,
    array_to_string(w[k + 1:], ' ') AS back
  FROM (SELECT lang, phrase, a, w, unnest(generate_series(1, words - 1)) AS k FROM cand)),
fronts AS MATERIALIZED (SELECT cuts.*, c.f AS l FROM cuts
  JOIN c ON c.lang = cuts.lang AND c.phrase = cuts.front),
scored AS (SELECT fronts.*, c.f AS r, ((1000000::HUGEINT * a * a) // (l::HUGEINT * c.f))::BIGINT AS score
  FROM fronts JOIN c ON c.lang = fronts.lang AND c.phrase = fronts.back),
lowest AS (SELECT scored.* FROM scored ANTI JOIN shadowed USING (lang, phrase)
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang
  ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM lowest)
SELECT ranked.lang, rank, phrase, a, l, r, n, score
FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
