"""N-gram Jaccard join by prefix filters under several global orders.

A document's set is its distinct word shingles, as 64-bit hashes. Equal sets become
one class. For a threshold t, two sets of similarity t or more share at least l
tokens among the first n - ceil(t n) + l of each, whatever the global order. The
filters of several orders are intersected before a pair is verified:

1. order A, by hash, with a large l: a class survives only if as many of its lead
   tokens (all of them in a small set) occur in other classes as any partner would need;
2. order R, rarest first among the lead tokens: pairs must share one of the few
   tokens that are left after l - 1 may be missed; this generates the candidates;
3. pairs that no leader settles must differ in few enough bits of their parities;
4. order B, another permutation of the hashes: their plain prefixes must meet;
5. what is left is verified on the whole sets.

Scale: about a quarter of the tokens is shuffled, as (token, class) rows; counts are
combined before the shuffle; texts never are. Candidates come through
``links.shared_key_components``, so a large group of near copies is held against
leaders and not squared. Broadcasts are counted first.

Null or empty texts, and texts without words, have an empty set and link with
nothing. Fewer words than a shingle make one shingle of them all. Rows with a null
id have no component. Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, links

WORDS = 4
#: Least similarity in hundredths.
PERCENT = 85
#: Lead tokens beyond the plain prefix: one in so many of the set, and lead tokens
#: of any set at least (all of a smaller one).
EXTRA, LEAD = 16, 112
#: Bits of a set's parities.
PARITY_BITS = 512
#: Odd numbers that mix word hashes and permute tokens (arbitrary fixed values).
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and every word's 64-bit hash in order. Each distinct word of
    the batch is hashed once."""
    import xxhash

    lengths, index, words = common.split_words(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    return lengths, hashes[index] if len(words) else np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles."""
    lengths, hashes = word_hashes(texts)
    whole = max(len(hashes) - words + 1, 0)
    grams = np.full(whole, MIX[0])
    for i in range(words):
        grams = mixed(grams * MIX[1] ^ hashes[i : i + whole])
    grams = grams.view(np.int64)
    end = 0
    for n in lengths:
        start, end = end, end + int(n)
        if n >= words:
            yield np.unique(grams[start : end - words + 1])
        elif n:
            yield np.frombuffer(hashlib.blake2b(hashes[start:end].tobytes(), digest_size=8, person=b"short").digest(), np.int64)
        else:
            yield np.zeros(0, np.int64)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def lead_length(n: int, percent: int) -> int:
    """Lead tokens of a set of n: the plain prefix and an allowance."""
    return min(n, max(LEAD, n - needed(n, percent) + 1 + n // EXTRA))


def allowance(n: int, percent: int) -> int:
    """How many of its lead tokens a set of n shares with a partner of its size."""
    return lead_length(n, percent) - (n - needed(n, percent))


@functools.lru_cache(maxsize=1 << 16)
def least_shared(n: int, percent: int) -> int:
    """How many lead tokens a set of n shares with any partner. With a smaller partner
    the overlap is what the set itself needs, so its own allowance bounds it; with a
    larger one the partner's allowance does. That is least at the ends of the range of
    sizes, or where the lead's two rules meet."""
    high = 100 * n // percent
    meet = [m for m in range(max(n, LEAD - 2), min(high, LEAD * 8)) if lead_length(m, percent) <= LEAD < lead_length(m + 1, percent)]
    return min(allowance(m, percent) for m in {n, high, *meet, *(m + 1 for m in meet)})


def _list(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from common.slices(b, 1, max_bytes=8 << 20)


def signatures(df: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """id, n (set size), node (128-bit digest of the set; null if empty), the lead
    tokens and how many of them any partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = list(shingle_sets(b.column(1), words))
            nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            leads = _list([s[: lead_length(len(s), percent)] for s in sets])
            least = pa.array([least_shared(len(s), percent) if len(s) else 0 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), leads, pc.list_value_length(leads), least], names=["id", "n", "node", "lead", "leads", "least"])

    schema = T.StructType([T.StructField("id", df.schema[key].dataType), T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("lead", T.ArrayType(T.LongType())), T.StructField("leads", T.IntegerType()), T.StructField("least", T.LongType())])
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(lambda it: common.released(run(it)), schema)


def parities(tokens: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits, each the parity of the number of tokens that fall on it. Where
    two sets' bits differ, they differ in a token: the bits that differ are at most as
    many as the tokens that only one of the sets has."""
    odd = np.bincount((mixed(tokens.view(np.uint64)) % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_condition(percent: int):
    """What the parities (x, y) and sizes (n, m) of linked sets meet: they share at
    least percent / (100 + percent) of n + m tokens."""

    def near(x, y, n, m):
        apart = sum(F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY_BITS // 64))
        return (100 + percent) * (n + m - apart) >= 2 * percent * (n + m)

    return near


def whole_sets(df: DataFrame, words: int, percent: int) -> DataFrame:
    """node, n, tokens, the prefix under order B and the parities, from (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = list(shingle_sets(b.column(1), words))
            nodes = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            other = [np.sort(mixed(s.view(np.uint64) ^ MIX[0]).view(np.int64))[: len(s) - needed(len(s), percent) + 1] for s in sets]
            part = pa.RecordBatch.from_arrays([nodes, pa.array([len(s) for s in sets], pa.int64()), _list(sets), _list(other), _list([parities(s) for s in sets])], names=["node", "n", "tokens", "other", "bits"])
            yield part.filter(pc.equal(nodes, b.column(0).cast(pa.binary())))  # an id may repeat with another text

    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType())), T.StructField("other", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    return df.mapInArrow(lambda it: common.released(run(it)), schema)


def candidates(classes: DataFrame) -> DataFrame:
    """Postings (key, node, rank, size) after orders A and R, from (place, node, n,
    lead, leads, least). A class whose lead tokens are common ones ranks first: the
    text that others are copies of leads. Only a token and its class's place, a small
    number, are shuffled."""
    tokens = classes.select("place", F.explode("lead").alias("key"))
    shared = tokens.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    own = tokens.join(shared, "key").groupBy("place").agg(F.collect_list(F.struct("df", "key")).alias("own"))
    held = own.join(classes.select("place", "node", "n", "leads", "least"), "place").where(F.size("own") >= F.col("least"))
    held = held.withColumn("own", F.sort_array("own"))
    rank = -F.aggregate("own", F.lit(0.0), lambda a, x: a + F.log(x["df"].cast("double"))) / F.col("leads")
    first = F.slice("own", 1, (F.size("own") - F.col("least") + 1).cast("int"))
    return held.select("node", rank.alias("rank"), F.col("n").alias("size"), F.explode(first).alias("t")).select(F.col("t.key").alias("key"), "node", "rank", "size")


def verifier(sets: DataFrame, percent: int):
    """Links among pairs (a, b): order B's filter, then the exact comparison."""

    def verify(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "tokens", "other"))) for c in "ab")
        near = pairs.join(one, "a").join(two, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        same = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return near.where(F.arrays_overlap("other_a", "other_b")).where(100 * same >= percent * (F.col("n_a") + F.col("n_b") - same)).select("a", "b")

    return verify


def group(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The operator: key, n_shingles and component_id (least key of those reachable
    by links; the row's own if it links with nothing)."""
    common.bound_batches(df.sparkSession)
    signed = signatures(df, key, text, words, percent).withColumn("place", F.monotonically_increasing_id())
    signed = common.materialize(signed, "signatures")  # places are fixed from here on
    real = signed.where("node is not null and id is not null")
    firsts = common.materialize(real.groupBy("node").agg(F.min("id").alias("first"), F.min("place").alias("place")), "firsts")
    firsts_side = common.small_enough(firsts)
    classes = signed.drop("id").join(firsts_side.select("place"), "place")
    first = common.materialize(candidates(classes), "candidates")
    postings = common.materialize(links.several(first), "postings")
    common.discard(first)
    wanted = postings.select("node").distinct().join(firsts_side.select("node", "first"), "node")
    wanted = common.small_enough(common.materialize(wanted, "wanted"))
    texts = df.select(F.col(key).alias("first"), F.col(text).cast("string").alias("t")).join(wanted, "first").select("node", "t")
    written = common.materialize(whole_sets(texts, words, percent).dropDuplicates(["node"]), "sets")
    sets = common.small_enough(written.drop("bits"))
    alike = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)
    groups = links.shared_key_components(postings, verifier(sets, percent), alike, sketch=(written.select("node", "bits"), parity_condition(percent)))
    least = groups.join(firsts.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    named = common.materialize(groups.join(least, "component").select("node", "least"), "groups")
    common.discard(written, postings, groups)
    return (
        signed.select("id", "n", "node")
        .join(firsts_side.select("node", "first"), "node", "left")
        .join(common.small_enough(named), "node", "left")
        .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "first", "id")).alias("component_id"))
    )


def group_sql(table: str, key: str = "doc_id", text: str = "text") -> str:
    """The same for DuckDB, by comparing all sets that share a shingle."""
    return f"""
with recursive words as (
    select {key}, regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from {table}),
sets as (
    select {key}, list_distinct(case when len(w) >= {WORDS} then list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' '))
                                     when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
posts as (select {key} as id, len(s) as n, unnest(s) as s from sets),
pairs as (select a.id as a, b.id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from posts a join posts b on a.s = b.s and a.id < b.id group by 1, 2),
near as (select a, b from pairs where 100 * k >= {PERCENT} * (n + m - k)),
edges as (select a, b from near union all select b, a from near),
reach as (select {key} as id, {key} as other from sets union select r.id, e.b from reach r join edges e on r.other = e.a)
select {key}, len(s)::bigint as n_shingles, least_id as component_id from sets join (select id, min(other) as least_id from reach group by 1) on id = {key}"""
