"""Byte-level BPE: encoding by a given rank file, and decoding.

A text is cut into pieces (contractions, words with a space before them, numbers, signs,
white space); the bytes of each piece are merged, always the leftmost pair of lowest rank
first, until no pair is a known token.  The same pieces come again and again, so only
*distinct* pieces are merged, by Spark's higher-order functions: ``aggregate`` folds the
merges over an array of byte strings whose neighbours' ranks stand beside them, and ranks
are looked up in a literal map, dealt over buckets so that a lookup stays short.

Documents are packed into units of bounded size as they are read: a unit keeps the list
of its distinct pieces and, for every document, the positions of its pieces in that list.
Only these move, not the texts.  Equal pieces of all units meet in a sorted stream, so a piece
that every document has costs one row for each unit; the tokens go back packed by unit.

Byte strings travel through the fold as text with one code point (0 to 255) for each byte.

Defined cases: NULL and empty texts have no tokens; NULL and repeated ids are documents of
their own; a document larger than a unit is a unit; an empty table gives an empty result;
only the two named columns are read.
"""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorumcast.llm.text_arrays import slices

UNIT_BYTES, SLICE_BYTES = 32 << 20, 1 << 20
#: Pieces of a unit turned into tokens at once (a longer document stands alone).
PIECES_AT_ONCE = 1 << 18
#: Answers a task holds before it packs them for their units.
ENTRIES = 1 << 18
#: Buckets of the literal rank map: a power of two.
BUCKETS = 1 << 16
NO_RANK = (1 << 31) - 1

LETTER, NUMBER, SIGN, SPACE = 1, 2, 3, 4
#: Code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


# --- pieces -------------------------------------------------------------------------


@functools.cache
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first in "LN":
            kinds[c] = LETTER if first == "L" else NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start, for UTF-8 texts laid end to end.

    Pieces are the matches of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)  # first byte of each character
    n = len(at)
    if n == 0:
        return at
    char = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _kinds()[char]
    row = np.searchsorted(at, offsets)
    first, last = row[:-1][row[:-1] < row[1:]], row[1:][row[:-1] < row[1:]] - 1
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first], after[last] = 0, 0
    blank = np.zeros(n, bool)  # a plain space before, in the same text
    blank[1:] = char[:-1] == 32
    blank[first] = False
    space = kind == SPACE
    # The last white space before something else starts anew; a plain space takes what follows with it.
    start = np.where(space, (before != SPACE) | ((after != SPACE) & (after != 0)), (before != kind) & ~blank)
    quote = np.flatnonzero((char == 39) & start & (after == LETTER))
    if len(quote):
        padded = np.concatenate([char, np.zeros(3, np.uint32)])
        one, two = padded[quote + 1], padded[quote + 2]
        within = np.searchsorted(last, quote + 2)
        two = np.where(quote + 2 <= last[np.minimum(within, len(last) - 1)], two, 0)
        two = np.where(np.isin(quote + 1, last), 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[quote[short | long] + 1] = False
        start = np.append(start, [False] * 3)
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
        start = start[:n]
    return at[start]


def _deflated(values: np.ndarray) -> bytes:
    """32-bit numbers, byte plane by byte plane, compressed; four bytes of count in front."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _inflated(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(pa.decompress(raw[4:], 4 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def _deflated_words(words: pa.Array) -> bytes:
    """A binary array, compressed: lengths, then bytes."""
    _, offsets, data = words.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8 if words.type == pa.large_binary() else 0)
    raw = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None else b""
    lengths = _deflated(np.diff(offsets))
    return len(lengths).to_bytes(4, "little") + lengths + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _inflated_words(raw: bytes) -> pa.Array:
    at = 4 + int.from_bytes(raw[:4], "little")
    lengths = _inflated(raw[4:at])
    size = int.from_bytes(raw[at:at + 8], "little")
    data = pa.decompress(raw[at + 8:], size, "zstd") if size else pa.py_buffer(b"")
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), data])


def _packed(unit: int, ids: list, sizes: list, pieces: list, id_type: pa.DataType) -> pa.RecordBatch:
    """One unit: its ids, pieces per document, positions of the pieces, distinct pieces (frequent ones first)."""
    coded = pa.chunked_array(pieces, pa.large_binary()).dictionary_encode()
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks] or [np.zeros(0, np.int32)])
    words = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_binary())
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
    return pa.RecordBatch.from_arrays([
        pa.array([unit], pa.int64()), one(pa.concat_arrays(ids), id_type), one(pa.array(np.concatenate(sizes)), pa.int64()),
        pa.array([_deflated(place[codes])], pa.binary()), pa.array([_deflated_words(words.take(pa.array(order)))], pa.binary())],
        names=["unit", "ids", "sizes", "codes", "words"])


def units(docs: DataFrame, id_column: str = "doc_id", text: str = "text", unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """Documents in units: ``unit``, ``ids``, ``sizes``, ``codes``, ``words``."""
    kind = docs.schema[id_column].dataType.simpleString()

    def kernel(batches):
        unit, held = TaskContext.get().partitionId() << 32, 0
        ids, sizes, pieces = [], [], []
        for batch in batches:
            for part, data, offsets in slices(batch, "text", SLICE_BYTES):
                if ids and held + len(data) > unit_bytes:
                    yield _packed(unit, ids, sizes, pieces, part.column("id").type)
                    unit, held, ids, sizes, pieces = unit + 1, 0, [], [], []
                at = piece_starts(data, offsets)
                ends = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
                pieces.append(pa.Array.from_buffers(pa.large_binary(), len(at), [None, ends, pa.py_buffer(data.tobytes())]))
                sizes.append(np.diff(np.searchsorted(at, offsets)))
                ids.append(part.column("id"))
                held += len(data)
        if ids:
            yield _packed(unit, ids, sizes, pieces, ids[0].type)

    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("text")) \
        .mapInArrow(kernel, f"unit bigint, ids array<{kind}>, sizes array<bigint>, codes binary, words binary")


# --- a unit's pieces go out and come back ---------------------------------------------


def asked(packed: DataFrame) -> DataFrame:
    """``word``, ``unit``, ``place``: the distinct pieces of every unit, sorted, which packs well."""
    def kernel(table):
        units, words, places = [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [np.zeros(0, np.int32)]
        for unit, packed_words in zip(table.column("unit").to_pylist(), table.column("words")):
            here = _inflated_words(packed_words.as_py())
            order = pc.sort_indices(here)
            words.append(here.take(order).cast(pa.binary()))
            places.append(order.to_numpy().astype(np.int32))
            units.append(np.full(len(here), unit, np.int64))
        return pa.table([pa.chunked_array(words), pa.array(np.concatenate(units)), pa.array(np.concatenate(places))], names=["word", "unit", "place"])

    return packed.groupBy("unit").applyInArrow(kernel, "word binary, unit bigint, place int")


def merged_once(pieces: DataFrame, table: Column) -> DataFrame:
    """``unit``, ``place``, ``tokens``: equal pieces stand together and only the first of them is merged."""
    same = Window.partitionBy("word")
    first = pieces.withColumn("nth", F.row_number().over(same.orderBy("unit"))).withColumn("own", F.when(F.col("nth") == 1, merged(F.col("word"), table)))
    return first.select("unit", "place", F.first("own", ignorenulls=True).over(same).alias("tokens"))


def answered(encoded: DataFrame) -> DataFrame:
    """``unit``, ``places``, ``sizes``, ``tokens``: what a task has for a unit, compressed into one row."""
    def packed(units, places, sizes, tokens):
        units, places, sizes, tokens = (np.concatenate(c) for c in (units, places, sizes, tokens))
        order = np.argsort(units, kind="stable")
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[order]
        ends = np.cumsum(lengths)
        tokens = tokens[np.arange(ends[-1]) + np.repeat(starts[order] - ends + lengths, lengths)]
        some, first = np.unique(units[order], return_index=True)
        cut, rows = np.append(first, len(order)), []
        for i, unit in enumerate(some.tolist()):
            a, b = cut[i], cut[i + 1]
            rows.append((unit, _deflated(places[order[a:b]]), _deflated(lengths[a:b]), _deflated(tokens[ends[a] - lengths[a]:ends[b - 1]])))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3))], names=["of", "places", "sizes", "tokens"])

    def kernel(batches):
        held, parts = 0, ([], [], [], [])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            found = batch.column("tokens")
            parts[0].append(batch.column("unit").to_numpy())
            parts[1].append(batch.column("place").to_numpy())
            parts[2].append(found.value_lengths().to_numpy().astype(np.int64))
            parts[3].append(found.flatten().to_numpy())
            held += batch.num_rows
            if held >= ENTRIES:
                yield packed(*parts)
                held, parts = 0, ([], [], [], [])
        if held:
            yield packed(*parts)

    return encoded.select("unit", "place", "tokens").mapInArrow(kernel, "of bigint, places binary, sizes binary, tokens binary")


# --- merges -------------------------------------------------------------------------


def rank_map(ranks: dict[bytes, int], buckets: int = BUCKETS) -> Column:
    """The ranks as a literal: an array of small maps, by hash of the token."""
    maps: list[dict[str, int]] = [{} for _ in range(buckets)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        maps[xxhash.xxh64_intdigest(text.encode(), 42) % buckets][text] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def merged(word: Column, table: Column, buckets: int = BUCKETS) -> Column:
    """Token ids of a binary column: ranked merges folded over its bytes."""

    def rank(maps, token):
        bucket = F.xxhash64(token).bitwiseAND(F.lit(buckets - 1).cast("bigint")).cast("int")
        return F.coalesce(F.element_at(F.get(maps, bucket), token), F.lit(NO_RANK))

    def with_rank(token, maps, following):
        return F.struct(token.alias("token"), F.when(following.isNull(), NO_RANK).otherwise(rank(maps, F.concat(token, following))).alias("rank"))

    def merge(maps):
        def at(state, i):  # i counts from 1: the leftmost pair of lowest rank is i, i + 1
            token = lambda k: F.get(state, k)["token"]
            new = F.concat(token(i - 1), token(i))
            here, left = with_rank(new, maps, token(i + 1)), with_rank(token(i - 2), maps, new)
            return F.when(F.get(state, i - 1)["rank"] == NO_RANK, state).otherwise(F.concat(
                F.slice(state, 1, F.greatest(i - 2, F.lit(0))), F.when(i > 1, F.array(left, here)).otherwise(F.array(here)),
                F.slice(state, i + 2, F.size(state))))

        return lambda state, _: F.aggregate(F.array(F.array_position(state["rank"], F.array_min(state["rank"])).cast("int")), state, at)

    def tokens(maps):
        text = F.decode(word, "ISO-8859-1")
        single = F.split(text, "")
        start = F.zip_with(single, F.slice(single, 2, F.length(text)), lambda a, b: with_rank(a, maps, b))
        steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - 1))
        folded = F.aggregate(steps, start, merge(maps), lambda state: F.transform(state["token"], lambda t: rank(maps, t)))
        return F.when(rank(maps, text) < NO_RANK, F.array(rank(maps, text))).otherwise(folded)

    # One occurrence of the literal, under a name.
    return F.get(F.transform(F.array(table), tokens), 0)


# --- both ways ----------------------------------------------------------------------


def encode(docs: DataFrame, ranks: dict[bytes, int], id_column: str = "doc_id", text: str = "text", unit_bytes: int = UNIT_BYTES,
           check: bool = False) -> DataFrame:
    """``id_column`` and ``ids``: the token ids as little-endian 32-bit numbers, four bytes each.

    With ``check`` also ``decoded``, as ``decode`` gives it, from the same tasks."""
    packed = units(docs, id_column, text, unit_bytes)
    replies = answered(merged_once(asked(packed), rank_map(ranks)))
    pieces = _pieces(ranks)

    def kernel(unit, back):
        unit = unit.combine_chunks()
        ids = unit.column("ids").chunk(0).flatten()
        sizes = unit.column("sizes").chunk(0).flatten().to_numpy()
        codes = _inflated(unit.column("codes")[0].as_py())
        places, lengths, values = (np.concatenate([np.zeros(0, np.uint32), *(_inflated(v.as_py()) for v in back.column(c))]) for c in ("places", "sizes", "tokens"))
        starts, length = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        starts[places], length[places] = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
        at = np.concatenate([[0], np.cumsum(sizes)])
        # Some documents at a time, each in a batch of its own, so that neither side holds a unit's result twice.
        batches, lo = [], 0
        while lo < len(sizes) or not batches:
            hi = min(len(sizes), max(lo + 1, int(np.searchsorted(at, at[lo] + PIECES_AT_ONCE, "right")) - 1))
            c = codes[at[lo]:at[hi]]
            n = length[c]
            ends = np.concatenate([[0], np.cumsum(n)])
            tokens = values[np.arange(ends[-1]) + np.repeat(starts[c] - ends[:-1], n)].astype("<u4")
            cut = ends[at[lo:hi + 1] - at[lo]]
            columns = [ids.slice(lo, hi - lo), pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((4 * cut).astype(np.int32)), pa.py_buffer(tokens)])]
            if check:
                columns.append(pa.array([_joined(tokens[i:j], pieces) for i, j in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.binary()))
            batches.append(pa.table(columns, names=["id", "ids", "decoded"][:len(columns)]))
            lo = hi
        return pa.concat_tables(batches)

    # Both readers of the units take whole rows, so that Spark shuffles the units once.
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, ids binary" + (", decoded binary" if check else "")
    return packed.groupBy("unit").cogroup(replies.groupBy("of")).applyInArrow(kernel, schema).withColumnRenamed("id", id_column)


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def _joined(ids: np.ndarray, pieces: list[bytes]) -> bytes:
    return b"".join([pieces[i] for i in ids.tolist()])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the tokens' bytes end to end, as binary."""
    pieces = _pieces(ranks)
    schema = T.StructType([*encoded.schema.fields, T.StructField(decoded, T.BinaryType())])

    def kernel(batches):
        for batch in batches:
            texts = [_joined(np.frombuffer(v.as_py() or b"", "<u4"), pieces) for v in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, decoded])

    return encoded.mapInArrow(kernel, schema)


def as_array(ids: Column) -> Column:
    """Token ids as an array of numbers."""
    def token(digits):
        backwards = F.concat(*[F.substr(digits, F.lit(7 - 2 * b), F.lit(2)) for b in range(4)])
        return F.conv(backwards, 16, 10).cast("int")

    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit("[0-9A-F]{8}"), F.lit(0)), token)
