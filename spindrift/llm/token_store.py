"""Content-addressed token store (operator 3).

Ids are cut into chunks where a rolling hash of the last eight ids says so, so equal passages give equal chunks. A chunk
is stored once under its 128-bit BLAKE2 address; a document is a recipe of addresses with a Merkle root, and each segment
of recipes (ascending doc_id) has a manifest row with a Merkle root over its documents. Reading checks every address, every
document's root against its chunks and every segment's root against its documents; a chunk that is not there is an error.
Chunk bodies move once, from the encoding task to the task that owns their address.

Null or empty text is a document of the end id alone. Rows with equal doc_id are separate documents. Extra columns are
ignored. An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, partitions, parts_of, scratch_dir, utf8_view
from .tokens import encoder

#: Ids a chunk has on average, and at most.
CHUNK_MEAN, CHUNK_MOST = 512, 4096
ADDRESS = 16

_RAW = "kind string, part int, doc_id long, n long, a binary, b binary"


def chunk_ends(ids: np.ndarray, offsets: np.ndarray, mean: int = CHUNK_MEAN, most: int = CHUNK_MOST) -> np.ndarray:
    """Ends of the chunks of a flat id stream; a chunk never crosses a document's end."""
    h = mix64(ids.astype(np.uint64) + np.uint64(1))
    for shift in (1, 2, 4):
        ahead = h.copy()
        ahead[shift:] += h[:-shift] * np.uint64(0xD6E8FEB86659FD93)
        h = ahead
    cut = mix64(h) % np.uint64(mean) == 0
    ends = np.unique(np.r_[np.flatnonzero(cut) + 1, offsets[1:]])
    ends = ends[ends > 0]
    starts = np.r_[0, ends[:-1]]
    extra = (ends - starts - 1) // most
    if extra.any():
        long = np.flatnonzero(extra)
        more = [np.arange(s + most, e, most) for s, e in zip(starts[long], ends[long], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def split_planes(ids: np.ndarray) -> bytes:
    """Ids as byte planes, lowest first; ids below 2**16 take two planes, others four."""
    wide = len(ids) and int(ids.max()) >= 1 << 16
    raw = np.ascontiguousarray(ids, "<u4" if wide else "<u2").view(np.uint8).reshape(-1, 4 if wide else 2)
    return np.ascontiguousarray(raw.T).tobytes()


def join_planes(body: bytes, n: int) -> np.ndarray:
    width = len(body) // n if n else 2
    raw = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(width, n).T)
    return raw.view("<u4" if width == 4 else "<u2").reshape(-1).astype("<u4")


def address(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(np.ascontiguousarray(ids, "<u4"), digest_size=ADDRESS).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd last node moves up unchanged."""
    level = leaves or [b""]
    while len(level) > 1:
        paired = [hashlib.blake2b(level[i] + level[i + 1], digest_size=ADDRESS).digest() for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the crc-32 polynomial, bits reflected."""
    out, m = 0, 1 << 31
    while m:
        if a & m:
            out ^= b
        m >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


_SHIFTS: dict[int, int] = {}


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes, modulo the crc-32 polynomial."""
    if n_bytes not in _SHIFTS:
        power, square, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                power = _times(power, square)
            square = _times(square, square)
            n >>= 1
        if len(_SHIFTS) > 100_000:
            _SHIFTS.clear()
        _SHIFTS[n_bytes] = power
    return _SHIFTS[n_bytes]


def crc32_join(parts: list[tuple[int, int]]) -> int:
    """crc-32 of a concatenation, from the (crc-32, bytes) of its parts."""
    out = 0
    for crc, n in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def _encode(path: str, end_id: int | None, parts: int):
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, squeeze = encoder(path), zstandard.ZstdCompressor(level=3)
        for batch in parts_of(batches, 1):
            data, offsets = utf8_view(batch.column(1))
            ids, off = tokens.encode(data, offsets)
            if end_id is not None:
                ids = np.insert(ids, off[1:], np.uint32(end_id))
                off = off + np.arange(len(off))
            if not len(batch):
                continue
            ends = chunk_ends(ids, off)
            starts = np.r_[0, ends[:-1]]
            names = [address(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            counts = (ends - starts).astype("<u4")
            first = np.searchsorted(ends, off, "right")
            for rows in _pack(names, counts, starts, ends, ids, parts, squeeze):
                yield rows
            doc_ids = batch.column(0).to_pylist()
            joined, sizes = b"".join(names), counts.tobytes()
            n = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["doc"] * n),
                    pa.array([hash((d, i)) % parts for i, d in enumerate(doc_ids)], pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(np.diff(off), pa.int64()),
                    pa.array([joined[a * ADDRESS : b * ADDRESS] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                    pa.array([sizes[a * 4 : b * 4] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary()),
                ],
                names=["kind", "part", "doc_id", "n", "a", "b"],
            )

    return run


def _pack(names, counts, starts, ends, ids, parts, squeeze) -> Iterator[pa.RecordBatch]:
    """The batch's distinct chunks, one compressed row for each owner."""
    place = {}
    for k, name in enumerate(names):
        place.setdefault(name, k)
    owners: dict[int, list[int]] = {}
    for name, k in place.items():
        owners.setdefault(int.from_bytes(name[:4], "little") % parts, []).append(k)
    part, blobs = [], []
    for owner, chunks in sorted(owners.items()):
        body = np.concatenate([ids[starts[k] : ends[k]] for k in chunks])
        head = b"".join(names[k] for k in chunks) + counts[chunks].tobytes()
        blobs.append(len(chunks).to_bytes(4, "little") + squeeze.compress(head + split_planes(body)))
        part.append(owner)
    n = len(part)
    yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * n), pa.array(part, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())], names=["kind", "part", "doc_id", "n", "a", "b"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes pass; of equal chunks one stays."""
    import zstandard

    seen, open_ = set(), zstandard.ZstdDecompressor()
    for batch in batches:
        kinds = batch.column(0).to_pylist()
        docs = pa.array([k == "doc" for k in kinds], pa.bool_())
        kept = batch.filter(docs)
        if len(kept):
            yield kept
        for k, kind in enumerate(kinds):
            if kind != "chunk":
                continue
            blob = batch.column(5)[k].as_py()
            m = int.from_bytes(blob[:4], "little")
            raw = open_.decompress(blob[4:])
            counts = np.frombuffer(raw, "<u4", m, m * ADDRESS)
            head = m * (ADDRESS + 4)
            ids = join_planes(raw[head:], int(counts.sum()))
            at, names, ns, bodies = 0, [], [], []
            for i, n in enumerate(counts.tolist()):
                name = raw[i * ADDRESS : (i + 1) * ADDRESS]
                if name not in seen:
                    seen.add(name)
                    names.append(name)
                    ns.append(n)
                    bodies.append(split_planes(ids[at : at + n]))
                at += n
            if names:
                z = len(names)
                yield pa.RecordBatch.from_arrays([pa.array(["chunk"] * z), pa.nulls(z, pa.int32()), pa.nulls(z, pa.int64()), pa.array(ns, pa.int64()), pa.array(names, pa.binary()), pa.array(bodies, pa.binary())], names=["kind", "part", "doc_id", "n", "a", "b"])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes of one segment in ascending doc_id: their places in it and their Merkle roots."""
    from pyspark import TaskContext

    segment, row, at = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = np.array(batch.column(1).to_pylist(), np.int64)
        names = batch.column(2).to_pylist()
        start = at + np.cumsum(n) - n
        at += int(n.sum())
        roots = [merkle([x[i : i + ADDRESS] for i in range(0, len(x), ADDRESS)]) for x in names]
        yield pa.RecordBatch.from_arrays(
            [pa.array([segment] * len(n), pa.int32()), pa.array(range(row, row + len(n)), pa.int64()), batch.column(0), pa.array(start), batch.column(1), batch.column(2), batch.column(3), pa.array(roots, pa.binary())],
            names=["segment", "row", "doc_id", "start_in_segment", "n_tokens", "addresses", "counts", "root"],
        )
        row += len(n)


def _manifest(table: pa.Table) -> pa.Table:
    t = table.sort_by("row")
    ids = [x for x in t.column("doc_id").to_pylist() if x is not None]
    return pa.table(
        {
            "segment": pa.array([t.column("segment")[0].as_py()], pa.int32()),
            "first_doc": pa.array([min(ids, default=None)], pa.int64()),
            "last_doc": pa.array([max(ids, default=None)], pa.int64()),
            "n_docs": pa.array([len(t)], pa.int64()),
            "n_tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()),
            "root": pa.array([merkle(t.column("root").to_pylist())], pa.binary()),
        }
    )


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 0) -> str:
    """Write documents (doc_id, text) as chunks, recipes and manifest under `path`; `tokenizer` is a tokenizers file."""
    spark = docs.sparkSession
    parts = partitions(spark)
    raw = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(tokenizer, end_id, parts), _RAW)
    raw.repartition(parts, "part").mapInArrow(_own, _RAW).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/raw")
    stored = _raw_table(spark, path)
    recipes = stored.where("kind = 'doc'").select("doc_id", F.col("n").alias("n_tokens"), F.col("a").alias("addresses"), F.col("b").alias("counts"))
    (
        recipes.repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "addresses")
        .mapInArrow(_recipes, "segment int, row long, doc_id long, start_in_segment long, n_tokens long, addresses binary, counts binary, root binary")
        .write.option("compression", "zstd")
        .parquet(f"{path}/recipes")
    )
    written = spark.read.parquet(f"{path}/recipes").select("segment", "row", "doc_id", "n_tokens", "root")
    written.groupBy("segment").applyInArrow(_manifest, "segment int, first_doc long, last_doc long, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/manifest")
    return path


def _raw_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, n long, a binary, b binary, kind string").parquet(f"{path}/raw")


def _check_segment(table: pa.Table) -> pa.Table:
    """A segment's manifest row as its recipes have it."""
    t = table.sort_by("row")
    if t.column("row").to_pylist() != list(range(len(t))):
        raise ValueError("a segment does not have all its documents")
    return pa.table({"segment": t.column("segment")[:1].cast(pa.int32()), "found_docs": pa.array([len(t)], pa.int64()), "found_tokens": pa.array([sum(t.column("n_tokens").to_pylist())], pa.int64()), "found": pa.array([merkle(t.column("root").to_pylist())], pa.binary())})


def _segment_starts(spark: SparkSession, path: str, recipes: DataFrame) -> DataFrame:
    """segment, before: ids of all segments before; fails where the manifest and the recipes do not agree."""
    found = recipes.select("segment", "row", "n_tokens", "root").groupBy("segment").applyInArrow(_check_segment, "segment int, found_docs long, found_tokens long, found binary")
    both = spark.read.parquet(f"{path}/manifest").join(found, "segment", "full")
    agrees = (F.col("root") == F.col("found")) & (F.col("n_docs") == F.col("found_docs")) & (F.col("n_tokens") == F.col("found_tokens"))
    before = F.sum("n_tokens").over(W.orderBy("segment")) - F.col("n_tokens")
    return both.select("segment", F.when(agrees, before).otherwise(F.raise_error(F.lit("a segment does not match its manifest")).cast("long")).alias("before"))


def _check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = []
        for name, n, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids = join_planes(body, n)
            if address(ids) != name:
                raise ValueError(f"chunk {name.hex()} does not match its address")
            crcs.append(zlib.crc32(ids))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["address", "n", "crc"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seg, row, names = [], [], []
        place = []
        for s, r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            k = len(x) // ADDRESS
            seg += [s] * k
            row += [r] * k
            place += range(k)
            names += [x[i * ADDRESS : (i + 1) * ADDRESS] for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int32()), pa.array(row, pa.int64()), pa.array(place, pa.int32()), pa.array(names, pa.binary())], names=["segment", "row", "place", "address"])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, counts = [], []
        for root, n, parts in zip(batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            parts = sorted(parts, key=lambda p: p["place"])
            if any(p["n"] is None for p in parts):
                raise ValueError("a chunk of a document is missing")
            if sum(p["n"] for p in parts) != n or merkle([p["address"] for p in parts]) != root:
                raise ValueError("a document does not match its Merkle root")
            crcs.append(crc32_join([(p["crc"], 4 * p["n"]) for p in parts]))
            counts.append(len(parts))
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("row"), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())], names=["segment", "row", "ids_crc32", "n_chunks"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _raw_table(spark, path).where("kind = 'chunk'").select("a", "n", "b").mapInArrow(_check_chunks, "address binary, n long, crc long")
    uses = recipes.select("segment", "row", "addresses").mapInArrow(_uses, "segment int, row long, place int, address binary")
    parts = uses.join(chunks, "address", "left").groupBy("segment", "row").agg(F.collect_list(F.struct("place", "n", "crc", "address")).alias("parts"))
    starts = _segment_starts(spark, path, recipes)
    rebuilt = recipes.select("segment", "row", "n_tokens", "root").join(parts, ["segment", "row"]).mapInArrow(_rebuild, "segment int, row long, ids_crc32 long, n_chunks long")
    # A document without an end id and without text has no chunk.
    whole = lambda c: F.when(F.col("n_tokens") == 0, 0).otherwise(F.coalesce(c, F.raise_error(F.lit("a document's chunks are missing")).cast("long"))).alias(c)
    return (
        recipes.join(rebuilt, ["segment", "row"], "left")
        .join(starts, "segment")
        .select("doc_id", (F.col("before") + F.col("start_in_segment")).alias("start"), "n_tokens", whole("ids_crc32"), whole("n_chunks"), F.lower(F.hex("root")).alias("merkle_root"))
    )


def _body(part: dict) -> np.ndarray:
    if part["n"] is None:
        raise ValueError("a chunk of a document is missing")
    ids = join_planes(part["body"], part["n"])
    if address(ids) != part["address"]:
        raise ValueError(f"chunk {part['address'].hex()} does not match its address")
    return ids


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.concatenate([_body(p) for p in sorted(parts, key=lambda p: p["place"])]) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])


def read_ids(spark: SparkSession, path: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """Whole documents: doc_id, ids, one row for each row that was written. `doc_ids` (a column doc_id) chooses some."""
    recipes = spark.read.parquet(f"{path}/recipes")
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = _raw_table(spark, path).where("kind = 'chunk'").select(F.col("a").alias("address"), "n", F.col("b").alias("body"))
    uses = recipes.select("segment", "row", "addresses").mapInArrow(_uses, "segment int, row long, place int, address binary")
    parts = uses.join(chunks, "address", "left").groupBy("segment", "row").agg(F.collect_list(F.struct("place", "n", "body", "address")).alias("parts"))
    return recipes.select("segment", "row", "doc_id").join(parts, ["segment", "row"]).select("doc_id", "parts").mapInArrow(_bodies, "doc_id long, ids array<long>")


def new_store_path(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/token-store-{uuid.uuid4().hex}"
