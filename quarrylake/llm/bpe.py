"""Byte-level BPE encoding and decoding with recursive DuckDB queries.

Each partition runs an in-process DuckDB. Texts are split by the vocabulary's
pattern, each distinct piece of a batch is encoded once: its token positions join
the merge table, the leftmost pair of least rank is contracted, and that repeats
in a recursive CTE until no pair is left. Decoding joins ids with the vocabulary
and aggregates the bytes in position order. Nothing is shuffled: the plan is a
scan and one Arrow map, and a lost task only repeats its own partition.

Nulls count as empty texts; an empty text has no tokens and the digests of no bytes; a
text of any length is encoded whole. Repeated rows give repeated rows, an empty table
an empty one. Null ids stay. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Text bytes that one round of extraction and encoding takes; bounds memory.
ROUND_BYTES = 1 << 20
#: Distinct pieces that one recursive query takes.
ROUND_WORDS = 8_000
#: Pieces over this many bytes go to the query that contracts row by row.
LONG_PIECE = 96
#: Distinct pieces that a partition remembers, with their ids, from batch to batch.
KNOWN_PIECES = 120_000
#: Bits for a token id in a packed pair.
ID_BITS = 17

#: The code points of the pattern's white space class, as the reference tokenizer
#: library sees them (fixed values).
SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Non-characters that may mark the end of a run of white space (fixed values).
MARKS = tuple(chr(x) for x in range(0xFDD0, 0xFDF0))
#: The pattern that this module can split without look-ahead (fixed value).
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Short pieces: a row per piece holds its ids; each step unnests the positions,
#: joins neighbours with the merge table, and splices in the least pair's token.
ENCODE_SHORT = """
with recursive step(w, ids, best) as (
    select w, ids, 0::bigint from pieces
    union all
    select s.w,
           case when m.best is null then s.ids
                else s.ids[:(m.best & 16777215) - 1] || [(m.best >> 24)::integer]
                     || s.ids[(m.best & 16777215) + 2:] end,
           m.best
    from step s left join (
        select n.w, min((g.rank::bigint << 24) | n.p) as best
        from (select w, unnest(ids[:-2]) as a, unnest(ids[2:]) as b,
                     generate_subscripts(ids[2:], 1) as p
              from step where best is not null and len(ids) > 1) n
        join merges g on g.pair = (n.a::bigint << 17) | n.b
        group by n.w) m using (w)
    where s.best is not null)
select w, ids from step where best is null
"""

#: Long pieces: a row per token. Where no merge made from a token can outrank it,
#: every non-overlapping occurrence of the least pair is contracted at once, which
#: gives what contracting them one by one from the left gives.
ENCODE_LONG = """
with recursive step(w, p, id, live) as (
    select w, p, id, true from positions
    union all
    select w, p, case when hit then best::integer else id end, best is not null
    from (
        select *, coalesce(lag(hit) over (partition by w order by p), false) as gone
        from (
            select *, rank = best and ((safe and (p_run % 2) = 0) or (not safe and p = first_p)) as hit
            from (
                select *, p_seq - min(p_seq) over (partition by w, run) as p_run,
                       min(case when rank = best then p end) over (partition by w) as first_p
                from (
                    select *, p_seq - sum((rank is not distinct from best)::integer)
                              over (partition by w order by p) as run
                    from (
                        select n.w, n.p, n.id, n.p_seq, g.rank, g.safe,
                               min(g.rank) over (partition by n.w) as best
                        from (select w, p, id, row_number() over (partition by w order by p) as p_seq,
                                     lead(id) over (partition by w order by p) as nx
                              from step where live) n
                        left join merges g on g.pair = (n.id::bigint << 17) | n.nx)
                ) where best is null or rank = best
                union all by name
                select *, null as p_run, null as first_p
                from (
                    select n.w, n.p, n.id, n.p_seq, g.rank, g.safe,
                           min(g.rank) over (partition by n.w) as best, 0 as run
                    from (select w, p, id, row_number() over (partition by w order by p) as p_seq,
                                 lead(id) over (partition by w order by p) as nx
                          from step where live) n
                    left join merges g on g.pair = (n.id::bigint << 17) | n.nx)
                where best is not null and rank is distinct from best
            )
        )
    ) where not gone)
select w, list(id order by p) as ids from step where not live group by w
"""

DECODE = """
select w, unhex(string_agg(v.hex, '' order by t.p)) as bytes
from (select w, unnest(ids) as id, generate_subscripts(ids, 1) as p from encoded) t
join vocabulary v using (id) group by w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.lru_cache(maxsize=2)
def tables(path: str) -> tuple[np.ndarray, pa.Table, pa.Table]:
    """A vocabulary's byte ids, merge table and tokens; a few MB."""
    ranks = read_ranks(path)
    if max(ranks.values()) >= 1 << ID_BITS:
        raise ValueError(f"ids need more than {ID_BITS} bits")
    pairs = [(a, b, r) for t, r in ranks.items() for i in range(1, len(t)) if (a := ranks.get(t[:i])) is not None and (b := ranks.get(t[i:])) is not None]
    least: dict[int, int] = {}
    for a, b, r in pairs:
        least[a], least[b] = min(least.get(a, r), r), min(least.get(b, r), r)
    merges = pa.table({"pair": pa.array([a << ID_BITS | b for a, b, _ in pairs], pa.int64()), "rank": pa.array([r for *_, r in pairs], pa.int32()), "safe": pa.array([least.get(r, r) >= r for *_, r in pairs])})
    words = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
    return np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32), merges, words


class Codec:
    """An in-process DuckDB that holds a merge table and a vocabulary. It lives as long
    as a partition: ``close`` gives its memory and its scratch folder back."""

    def __init__(self, path: str):
        import duckdb

        self.of_byte, merges, words = tables(path)
        common.trim()  # what reading the ranks took
        self.scratch = tempfile.mkdtemp(prefix="bpe-")  # DuckDB's own, read by nobody else
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "128MB", "temp_directory": self.scratch})
        self.known = [pa.array([], pa.string()), pa.array([], pa.list_(pa.int32())), pa.array([], pa.binary())]
        for name, table in (("merges", merges), ("vocabulary", words)):
            self.db.register("incoming", table)
            self.db.execute(f"create table {name} as select * from incoming")
            self.db.unregister("incoming")

    def close(self) -> None:
        self.db.close()
        self.known = []
        shutil.rmtree(self.scratch, ignore_errors=True)

    def _query(self, sql: str, **tables: pa.Table) -> pa.Table:
        for name, table in tables.items():
            self.db.register(name, table)
        out = self.db.sql(sql).to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return out

    def split(self, texts: pa.Array, pattern: str) -> tuple[np.ndarray, pa.Array]:
        """Pieces of all texts in order: pieces per text, and the pieces."""
        mark = next((m for m in MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if pattern != PLAIN_PATTERN or mark is None:
            import regex

            found = [regex.findall(pattern, t) for t in texts.to_pylist()]
            return np.array([len(x) for x in found], dtype=np.int64), pa.array([p for x in found for p in x], pa.string())
        # A run of white space before a word leaves its last character to the word.
        marked = pc.replace_substring_regex(texts, f"([{SPACES}])([{SPACES}][^{SPACES}])", f"\\1{mark}\\2")
        own = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACES}{mark}\\p{{L}}\\p{{N}}]+|[{SPACES}]+"
        lists = self._query("select regexp_extract_all(t, '" + own.replace("'", "''") + "') as x from texts", texts=pa.table({"t": marked}))["x"].combine_chunks()
        return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()

    def encode_words(self, words: pa.Array) -> pa.Array:
        """The ids of each piece, as a list array in the order of ``words``."""
        if not len(words):
            return pa.array([], pa.list_(pa.int32()))
        words = pa.concat_arrays([words.cast(pa.large_binary())])
        starts = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        ids, lengths = self.of_byte[np.frombuffer(words.buffers()[2], np.uint8)[starts[0] : starts[-1]]], np.diff(starts)
        starts = starts - starts[0]
        parts = []
        for at in range(0, len(words), ROUND_WORDS):
            to = min(at + ROUND_WORDS, len(words))
            lists = pa.ListArray.from_arrays(pa.array((starts[at : to + 1] - starts[at]).astype(np.int32)), pa.array(ids[starts[at] : starts[to]]))
            short = pa.table({"w": pa.array(np.arange(at, to)), "ids": lists})
            if (lengths[at:to] > LONG_PIECE).any():
                short = short.filter(pa.array(lengths[at:to] <= LONG_PIECE))
            parts.append(self._query(ENCODE_SHORT, pieces=short))
        for i in np.flatnonzero(lengths > LONG_PIECE):
            own = ids[starts[i] : starts[i + 1]]
            parts.append(self._query(ENCODE_LONG, positions=pa.table({"w": np.full(len(own), i), "p": np.arange(len(own)), "id": own})))
        found = pa.concat_tables(p.cast(pa.schema([("w", pa.int64()), ("ids", pa.list_(pa.int32()))])) for p in parts).combine_chunks()
        return found["ids"].combine_chunks().take(pc.sort_indices(found["w"]))

    def decode_words(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids, in order."""
        if not len(ids):
            return pa.array([], pa.binary())
        out = self._query(DECODE, encoded=pa.table({"w": pa.array(range(len(ids)), pa.int64()), "ids": ids}))
        return out["bytes"].combine_chunks().take(pc.sort_indices(out["w"])).cast(pa.binary())

    def encode(self, texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """For texts without nulls: where each text's ids end, all ids, where each
        text's decoded bytes end, and all decoded bytes."""
        counts, pieces = self.split(texts, pattern)
        coded = pieces.dictionary_encode()
        lists, back, places = self.lookup(coded.dictionary)
        places = places[coded.indices.to_numpy(zero_copy_only=False)]
        ends = np.cumsum(counts)
        until = lambda lengths: np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64)[places])])[ends]
        id_ends, byte_ends = until(pc.list_value_length(lists)), until(pc.binary_length(back))
        ids = lists.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype("<u4")
        data = back.cast(pa.large_binary()).take(pa.array(places)).buffers()[2]
        return id_ends, ids, byte_ends, data.to_pybytes()[: byte_ends[-1] if len(byte_ends) else 0] if data else b""

    def lookup(self, words: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Ids and bytes of distinct pieces, and each piece's place in them. Pieces
        met before in this worker come from a memory of KNOWN_PIECES pieces."""
        at = pc.index_in(words, value_set=self.known[0])
        new = words.filter(pc.is_null(at))
        lists = self.encode_words(new)
        back = self.decode_words(lists)
        places = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        places[pc.is_null(at).to_numpy(zero_copy_only=False)] = len(self.known[0]) + np.arange(len(new))
        joined = [pa.concat_arrays([old, fresh.cast(old.type)]) for old, fresh in zip(self.known, (new, lists, back), strict=True)]
        room = max(KNOWN_PIECES - len(self.known[0]), 0)
        if room and len(new):
            if pc.max(pc.binary_length(new)).as_py() <= LONG_PIECE:
                self.known = [pa.concat_arrays([x.slice(0, len(self.known[0]) + room)]) for x in joined]
        return joined[1], joined[2], places


def rounds(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ROUND_BYTES of text; a longer text has a round alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + ROUND_BYTES, side="right")))
        yield at, to
        at = to


def _each_round(batches: Iterator[pa.RecordBatch], path: str, pattern: str, make: Callable) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    try:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            texts = texts.cast(pa.string()) if texts.type != pa.string() else texts
            for at, to in rounds(texts):
                id_ends, ids, byte_ends, data = codec.encode(texts.slice(at, to - at), pattern)
                yield from make(batch.column(0).slice(at, to - at), id_ends, ids, byte_ends, data)
    finally:
        codec.close()


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The operator: ``key``, ``ids`` array<int> and the round trip's ``decoded`` bytes."""

    def make(keys, id_ends, ids, byte_ends, data):
        starts = lambda e: np.concatenate([[0], e])
        lists = pa.ListArray.from_arrays(pa.array(starts(id_ends).astype(np.int32)), pa.array(ids.astype(np.int32)))
        decoded = pa.array([data[a:b] for a, b in zip(starts(byte_ends), byte_ends, strict=False)], pa.binary())
        yield pa.RecordBatch.from_arrays([keys, lists, decoded], names=[key, "ids", "decoded"])

    common.bound_batches(df.sparkSession)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return df.select(key, F.col(text).cast("string")).mapInArrow(lambda it: common.released(_each_round(it, path, pattern, make)), schema)


def digest(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, and SHA-256 of the ids (little-endian 32-bit) and of the decoded bytes.

    The hashes are taken where the ids are made, so ids never leave the worker.
    """

    def make(keys, id_ends, ids, byte_ends, data):
        raw, view = ids.tobytes(), memoryview(data)
        id_at, byte_at = np.concatenate([[0], id_ends]), np.concatenate([[0], byte_ends])
        hashed = lambda b, at, unit: [hashlib.sha256(b[at[i] * unit : at[i + 1] * unit]).hexdigest() for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays(
            [keys, pa.array(np.diff(id_at), pa.int64()), pa.array(hashed(memoryview(raw), id_at, 4)), pa.array(hashed(view, byte_at, 1))],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    common.bound_batches(df.sparkSession)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return df.select(key, F.col(text).cast("string")).mapInArrow(lambda it: common.released(_each_round(it, path, pattern, make)), schema)
