"""Exact Jaccard join of documents on word n-grams, through a token-group matrix.

1. Texts become sets of 64-bit shingle hashes. Equal sets are one class, spoken
   for by its smallest doc_id; only these representatives go on.
2. A fixed-size sketch of how often shingles repeat gives all sets one common
   order of tokens, rare ones first. Two sets that link must share a token
   among the first few of each (the prefix lemma), so only prefixes are
   shuffled; very frequent tokens are dealt out over salted parts.
3. Grouping: within the rows of a token, each set is compared with the one that
   has the token earliest in its order (the text that others are copies of).
   Linked sets form groups by connected components.
4. Token-group matrix: for each token the groups whose members have it in their
   prefix, by band of set size, with the most that can still follow. A query set meets
   only the groups of its tokens; by the best overlap they could have, most
   groups stay closed.
5. Of each group that qualifies, first only one member is opened: the one that
   heads the group on most of the query's tokens. Where they link, the query
   joins the group. After ``HEAD_ROUNDS`` of this, the groups that still qualify
   are opened and their members compared exactly: those sharing a token, or all
   of a fitting size where that makes fewer rows (a small group that shares many
   tokens with many queries).
6. Components over all links.

Within a group nothing needs comparing (its members are already connected), so
the pairs of a large family of copies are never enumerated, and every link
between different groups is still found.

Defined cases: null and empty texts and texts of white space have the empty set
and are a component of their own; rows with a null doc_id get a null
component_id and link with nothing; rows that repeat a doc_id each get a row,
and a link of any of them is a link of that id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyroll.llm.common import attach, documents, done_with, saved, small_batches
from skyroll.llm.components import components

SHINGLE = 5
NUM, DEN = 75, 100       # link when DEN * intersection >= NUM * union
SKETCH_BITS = 20         # counters of the frequency sketch (one byte each when shared)
COMMON = 16              # repeats from which a counter orders its tokens last
SALT_FROM = 9            # tokens of 2**10 rows and more are dealt over parts of about 2**9
STAR_LEADERS = 2         # leaders a set is compared with when groups are formed
STAR_SHARE = 8           # ... where it shares one in so many tokens of its prefix
SIZE_BANDS = 16          # bands of set sizes in the matrix, per factor of e
HEAD_ROUNDS = 1          # rounds in which groups that link by a head are merged
BATCH_ROWS = 2000
HASHED_AT_ONCE = 1 << 20  # bytes of text whose words are hashed at a time, or one word
PROFILE_BITS = 9         # a set's profile counts its tokens in 2**9 parts
PROFILE_FULL = 255       # ... up to so many in each
IDS_SENT = 1_000_000     # wanted documents whose ids are sent to the scan of the texts

# Odd multipliers of the hashes (any odd 64-bit numbers do).
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                                0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            size = max(n, 1 << 16)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _P)]),
                                dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]),
                                  dtype=np.uint64)
        return cls.up, cls.down


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each text begins and ends."""
    texts = texts.fill_null("")
    raw = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts) or raw[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(raw[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(raw[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lowered), and where each text's words begin."""
    data, ends = _text_bytes(texts)
    n = len(ends) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = blank[:-1]
    edge[ends[ends < len(data)]] = True          # a text ends its last word
    first = np.flatnonzero(edge[:-1] & ~blank)
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = blank[1:]
    stop[ends[1:][ends[1:] > 0] - 1] = True
    last = np.flatnonzero(stop & ~blank) + 1
    h = np.empty(len(first), dtype=np.uint64)
    i = 0
    while i < len(first):        # a word's hash doesn't depend on its place
        j = max(i + 1, int(np.searchsorted(last, first[i] + HASHED_AT_ONCE, side="right")))
        a, z = first[i], last[j - 1]
        part, begin, end = data[a:z], first[i:j] - a, last[i:j] - a
        low = part + np.where((part >= 65) & (part <= 90), np.uint8(32), np.uint8(0))
        up, down = _Powers.get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:len(part)], out=total[1:])
        h[i:j] = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        i = j
    return h, np.searchsorted(first, ends)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    whole = np.zeros(0, np.uint64)
    if len(words) >= size:
        run = np.zeros(len(words) - size + 1, dtype=np.uint64)
        for k in range(size):
            run += words[k:len(words) - size + 1 + k] * _WORD[k % len(_WORD)] + np.uint64(k)
        whole = _mix(run)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(whole[a:b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64) * _P
            for k in range(b - a):
                short = short + words[a + k:a + k + 1] * _WORD[k % len(_WORD)]
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch counters of the shingles that several texts of a batch share."""
    for b in batches:
        sets = shingle_sets(b.column("text"))
        every = np.sort(np.concatenate([*sets, np.zeros(0, np.uint64)]))
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) \
            if len(every) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(every)))
        bucket = (every[at[n > 1]] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(n[n > 1], pa.int64())], ["bucket", "n"])


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """log2 of how often the tokens of each counter repeat, 0 for rare ones.

    It only orders tokens (a wrong order costs time, not links), so its size is
    fixed: at most ``2 ** SKETCH_BITS`` short rows reach the driver."""
    rows = (docs.select("text").mapInArrow(_repeats, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)).toArrow()
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    sketch[rows.column("bucket").to_numpy()] = np.log2(rows.column("n").to_numpy()).astype(np.uint8)
    return sketch


def profile(tokens: np.ndarray) -> bytes:
    """How many tokens fall into each part of the hash space. Two sets share at most
    the sum of the smaller counts, which takes far fewer bytes than their tokens."""
    part = (tokens >> np.uint64(16)) & np.uint64((1 << PROFILE_BITS) - 1)
    count = np.bincount(part.astype(np.int64), minlength=1 << PROFILE_BITS)
    return np.minimum(count, PROFILE_FULL).astype(np.uint8).tobytes()


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose profiles and sizes allow a link (a full part allows any)."""
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(
            -1, 1 << PROFILE_BITS) for c in ("profile_a", "profile_b"))
        least = np.minimum(x, y)
        both = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
        keep = (((NUM + DEN) * least.sum(axis=1, dtype=np.int64) >= NUM * both)
                | (least == PROFILE_FULL).any(axis=1))
        yield b.select(["a", "b"]).filter(pa.array(keep))


def prefix_sets(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """doc_id, size, signature and profile of each set, and its prefix in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in batches:
            n, sig_a, sig_b, tokens, bits, profiles = [], [], [], [], [], []
            for s in shingle_sets(b.column("text")):
                n.append(len(s))
                sig_a.append(int(_mix(s ^ _P).sum(dtype=np.uint64).view(np.int64)))
                sig_b.append(int(_mix(s + _P).sum(dtype=np.uint64).view(np.int64)))
                profiles.append(profile(s))
                take = len(s) - -(-NUM * len(s) // DEN) + 1 if len(s) else 0
                rank = common[s >> np.uint64(64 - SKETCH_BITS)]
                if rank.any():
                    order = np.lexsort((s, rank))[:take]
                    s, rank = s[order], rank[order]
                tokens.append(s[:take].view(np.int64))
                bits.append(np.maximum(rank[:take].astype(np.int32) - SALT_FROM, 0))
            cut = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            flat = lambda x, t: pa.ListArray.from_arrays(
                pa.array(cut), pa.array(np.concatenate([*x, np.zeros(0, t)]).astype(t)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int32()), pa.array(sig_a, pa.int64()),
                 pa.array(sig_b, pa.int64()), flat(tokens, np.int64), flat(bits, np.int32),
                 pa.array(profiles, pa.binary())],
                ["doc_id", "n", "sig_a", "sig_b", "tokens", "bits", "profile"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        build, "doc_id long, n int, sig_a long, sig_b long, tokens array<long>, bits array<int>, "
               "profile binary")


def _token_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (token, salt, pos ...): adds the first row's document as
    leader and drops tokens of one row (unless salted)."""
    held: pa.Table | None = None

    def close(t: pa.Table) -> pa.RecordBatch:
        token, salt = t.column("token").to_numpy(), t.column("salt").to_numpy()
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(token)))
        lead = np.repeat(t.column("doc_id").to_numpy()[at], size)
        lead_n = np.repeat(t.column("n").to_numpy()[at], size)
        keep = pa.array((np.repeat(size, size) > 1) | (t.column("bits").to_numpy() > 0))
        t = t.append_column("leader", pa.array(lead)).append_column("leader_n", pa.array(lead_n))
        t = t.filter(keep).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in t.columns], t.column_names)

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if held.num_rows < 50_000:
            continue
        token, salt = held.column("token").to_numpy(), held.column("salt").to_numpy()
        new = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
        if len(new):  # the last run may go on in the next batch
            yield close(held.slice(0, int(new[-1]) + 1))
            held = held.slice(int(new[-1]) + 1)
    if held is not None and held.num_rows:
        yield close(held)


def shared_tokens(sets: DataFrame) -> DataFrame:
    """The prefix rows of tokens that at least two sets have, with leaders."""
    rows = (sets.select("doc_id", "n", F.posexplode(F.arrays_zip("tokens", "bits")).alias("pos", "t"))
            .select("doc_id", "n", "pos", F.col("t.tokens").alias("token"),
                    F.col("t.bits").alias("bits"))
            .withColumn("salt", F.expr("CAST(pmod(xxhash64(doc_id), shiftleft(1L, bits)) AS INT)")))
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = ("doc_id long, n int, pos int, token long, bits int, salt int, "
              "leader long, leader_n int")
    return (rows.repartition(parts, "token", "salt")
            .sortWithinPartitions("token", "salt", "pos", "n", "doc_id")
            .mapInArrow(_token_runs, schema))


def _fits(n_a, n_b):
    """Sizes of two sets that can link."""
    return ((DEN * F.least(n_a, n_b)) >= (NUM * F.greatest(n_a, n_b)))


def linked(pairs: DataFrame, docs: DataFrame, profiles: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose sets link, saved. Profiles rule out most pairs that don't;
    of the documents in the others, whole sets are built from their texts and compared."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b"), strict=True):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                t = np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([s, t])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                union = len(both) - inter
                keep.append(union > 0 and DEN * inter >= NUM * union)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    spark = docs.sparkSession
    side = {x: profiles.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"),
                               F.col("profile").alias(f"profile_{x}")) for x in "ab"}
    pairs = saved(pairs.select("a", "b").join(side["a"], "a").join(side["b"], "b")
                  .select("a", "b", "n_a", "n_b", "profile_a", "profile_b")
                  .mapInArrow(_may_link, "a long, b long").distinct(), f"{name}-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = saved(full_sets(docs, wanted), f"{name}-sets")
    done_with(spark)
    out = saved(pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
                .join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
                .mapInArrow(test, "a long, b long"), f"{name}-links")
    done_with(spark, pairs, sets)
    return out


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The whole sets of the ``wanted`` documents."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.tobytes() for s in shingle_sets(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())],
                                             ["doc_id", "set"])

    few = wanted.count() <= IDS_SENT         # texts are shuffled only beyond that
    ids = F.broadcast(wanted) if few else wanted.hint("shuffle_hash")
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(ids, "doc_id", "left_semi").mapInArrow(build, "doc_id long, set binary"))


def star_pairs(shared: DataFrame) -> DataFrame:
    """Each set with the leaders it shares most tokens with, if these are a fair
    part of the prefix (links on fewer are left to the groups), and the leaders of
    a salted token's parts with that token's first leader."""
    prefix = F.least("n", "leader_n") * F.lit(DEN - NUM) / DEN
    votes = (shared.where((F.col("doc_id") != F.col("leader")) & _fits(F.col("n"), F.col("leader_n")))
             .groupBy("doc_id", "leader", prefix.alias("prefix"))
             .agg(F.count(F.lit(1)).alias("votes"))
             .where(F.col("votes") * STAR_SHARE >= F.col("prefix")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("votes"), "leader"))
    own = (votes.withColumn("rank", rank).where(F.col("rank") <= STAR_LEADERS)
           .select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))
    heads = shared.where((F.col("bits") > 0) & (F.col("doc_id") == F.col("leader"))).select(
        "token", "leader")
    first = heads.groupBy("token").agg(F.min("leader").alias("first"))
    across = (heads.join(first, "token").where(F.col("leader") != F.col("first"))
              .select(F.col("leader").alias("a"), F.col("first").alias("b")))
    return own.unionByName(across).distinct()


def grouped_rows(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Prefix rows with the group of their set (itself where it has no link)
    and the band of its size."""
    return (shared.select("token", "doc_id", "n", "pos")
            .join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")),
                  "doc_id", "left")
            .withColumn("grp", F.coalesce("grp", "doc_id"))
            .withColumn("band", F.floor(F.log("n") * SIZE_BANDS))
            .withColumn("indexed", F.col("pos") <= F.col("n") - F.ceil(
                F.lit(2 * NUM) * F.col("n") / (NUM + DEN))))


def qualifying_rows(rows: DataFrame) -> DataFrame:
    """Query rows (doc_id, n, pos, token) with each group and size band in which
    the matrix lets a member link by this token; ``head`` is the member that has
    the token earliest, ``have`` the number of members.

    A member can follow on a shared token with at most ``rest`` tokens, the
    query with ``n - pos``; the smaller must reach the overlap that sizes ask
    for. The first token that two linked sets share always passes.
    """
    matrix = (rows.where("indexed").groupBy("token", F.col("grp").alias("other"),
                                            F.col("band").alias("m_band"))
              .agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"),
                   F.max(F.col("n") - F.col("pos")).alias("rest"),
                   F.count(F.lit(1)).alias("have"),
                   F.min(F.struct("pos", "doc_id")).alias("first")))
    smallest = F.greatest(F.col("least_n"), F.ceil(F.col("n") * NUM / DEN))
    return (rows.join(matrix, "token").where(
        (F.col("grp") != F.col("other")) & (F.col("least_n") <= F.col("n"))
        & (DEN * F.col("most_n") >= NUM * F.col("n"))
        & ((NUM + DEN) * F.least(F.col("n") - F.col("pos"), F.col("rest"))
           >= NUM * (F.col("n") + smallest)))
        .select("doc_id", "n", "pos", "token", F.col("other").alias("grp"),
                F.col("m_band").alias("band"), "have", F.col("first.doc_id").alias("head")))


def qualifying_groups(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, n, grp, head, whole) of the groups with qualifying rows.

    ``head`` is the head on most rows; ``whole`` tells that the group has fewer
    members than these rows would open.
    """
    members = rows.select("grp", "doc_id").distinct().groupBy("grp").agg(
        F.count(F.lit(1)).alias("members"))
    return (asked.groupBy("doc_id", "n", "grp", "head")
            .agg(F.count(F.lit(1)).alias("votes"), F.sum("have").alias("have"))
            .groupBy("doc_id", "n", "grp")
            .agg(F.max(F.struct("votes", "head")).alias("best"), F.sum("have").alias("have"))
            .join(members, "grp")
            .select("doc_id", "n", "grp", F.col("best.head").alias("head"),
                    (F.col("members") < F.col("have")).alias("whole")))


def opened_pairs(rows: DataFrame, asked: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of a query and a member of a qualifying group whose sizes allow a
    link and which, unless the group is opened whole, share a prefix token at
    places that allow one."""
    older = F.struct("m_n", "m_id") < F.struct("n", "doc_id")
    member = rows.where("indexed").select(
        "token", "grp", "band", F.col("doc_id").alias("m_id"), F.col("n").alias("m_n"),
        F.col("pos").alias("m_pos"))
    ask = asked.select("doc_id", "n", "pos", "token", "grp", "band").join(
        groups.where("whole").select("doc_id", "grp"), ["doc_id", "grp"], "left_anti")
    by_token = (ask.join(member, ["token", "grp", "band"])
                .where(older & _fits(F.col("n"), F.col("m_n"))
                       & ((NUM + DEN) * F.least(F.col("n") - F.col("pos"),
                                                F.col("m_n") - F.col("m_pos"))
                          >= NUM * (F.col("n") + F.col("m_n")))))
    by_group = (groups.where("whole").select("doc_id", "n", "grp")
                .join(member.select("grp", "m_id", "m_n").distinct(), "grp")
                .where(older & _fits(F.col("n"), F.col("m_n"))))
    pair = [F.col("doc_id").alias("a"), F.col("m_id").alias("b")]
    return by_token.select(*pair).unionByName(by_group.select(*pair)).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark, BATCH_ROWS)
    prefixes = saved(prefix_sets(docs, frequency_sketch(docs)), "prefix-sets")
    sets = saved(prefixes.select("doc_id", "n", "sig_a", "sig_b"), "set-signatures")
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    profiles = saved(prefixes.where(real).select("doc_id", "n", "profile"), "set-profiles")
    classes = saved(sets.where(real).groupBy("sig_a", "sig_b", "n")
                    .agg(F.min("doc_id").alias("speaker"), F.count(F.lit(1)).alias("members")),
                    "set-classes")
    speakers = (prefixes.where(real)
                .join(classes.select(F.col("speaker").alias("doc_id"), "sig_a", "sig_b"),
                      ["doc_id", "sig_a", "sig_b"])
                .dropDuplicates(["doc_id", "sig_a", "sig_b"]))
    shared = saved(shared_tokens(speakers), "shared-tokens")
    done_with(spark, prefixes)
    near = linked(star_pairs(shared), docs, profiles, "star")
    for turn in range(HEAD_ROUNDS + 1):
        rows = saved(grouped_rows(shared, components(near)), "grouped-tokens")
        asked = saved(qualifying_rows(rows), "qualifying-rows")
        opened = saved(qualifying_groups(asked, rows), "qualifying-groups")
        if turn < HEAD_ROUNDS:
            heads = opened.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
            near = near.unionByName(linked(heads, docs, profiles, "head"))
            done_with(spark, rows, asked, opened)
    far = linked(opened_pairs(rows, asked, opened), docs, profiles,
                 "opened")
    done_with(spark, shared, rows, asked, opened, profiles)
    found = components(near.unionByName(far))
    of_class = (classes.join(found.select(F.col("node").alias("speaker"), "component"),
                             "speaker", "left")
                .select("sig_a", "sig_b", "n", "members",
                        F.coalesce("component", "speaker").alias("component_id")))
    alone = sets.where(~real).select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    placed = attach(sets.where(real), saved(of_class, "class-components"),
                    ["sig_a", "sig_b", "n"], "members")
    return placed.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                         "component_id").unionByName(alone)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))
