"""Media columns stored as content-defined chunks (operator 10)."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.llm.common import join_one, stash

MIN, MAX, MASK_BITS = 256, 8192, 10
#: Up to so many shared chunk digests (8 bytes of each) go to every executor; beyond, every chunk goes to the chunk table.
BROADCAST_SHARED = 2_000_000
#: So many chunks (of MAX bytes at most) that more than 1000 distinct media share are broadcast to those that want them.
HOT_CHUNKS = 2000
RATE = 8000


def _gear() -> np.ndarray:
    """256 fixed 32-bit values from a digest of each byte."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=4).digest(), "little") for i in range(256)], dtype=np.uint32)


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i-k]] << k over the last 32 bytes: the rolling hash at every byte, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    return h


def cut_points(data: bytes, least: int = MIN, most: int = MAX, bits: int = MASK_BITS) -> list[int]:
    """Ends of the chunks: where the top bits of the rolling hash are 0, at least `least` and at most `most` apart."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    marks = (np.nonzero(gear_hashes(np.frombuffer(data, np.uint8)) >> np.uint32(32 - bits) == 0)[0] + 1).tolist()
    out, at = [], 0
    for m in [*marks, n]:
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least or m == n and m > at:
            at = m
            out.append(at)
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def wav_header(n: int) -> bytes:
    """Header of n 8-bit mono samples; a chunk of odd length would need a pad byte, which callers' lengths avoid."""
    return b"RIFF" + struct.pack("<I", (36 + n) & 0xFFFFFFFF) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n & 0xFFFFFFFF)


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zero bytes to a positive multiple of 64, and the length before that."""
    raw = text.encode() if text else b""
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0)), len(raw)


def _prefix(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def store(df: DataFrame, id_col: str, source_col: str, path: str, payload: Callable = text_payload) -> None:
    """Write the media of each row as content-defined chunks below path.

    `manifests`: one row per input row with its length, its header, its digest and, in order, the digest, length and, where no
    other place has the same chunk, the bytes of its chunks. `chunks`: every chunk that two places share, once.
    First the digests alone are counted by a Spark aggregation; which are shared is what decides where bytes go, so
    bytes of unshared chunks never leave their row. Where the shared digests are too many to send out, all chunks
    go to the chunk table and the reader joins all of them: the same result with more shuffling.
    """
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(0):
                data, _ = payload(text.as_py())
                at = 0
                for end in cut_points(data):
                    out.append(digest(data[at:end]))
                    at = end
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["d"])

    counts = src.select("src").mapInArrow(digests, "d binary").groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d")
    counts.write.option("compression", "zstd").parquet(f"{path}/shared")
    shared_table = spark.read.schema("d binary").parquet(f"{path}/shared")
    few = shared_table.count() <= BROADCAST_SHARED
    known = np.sort(np.array([_prefix(r["d"]) for r in shared_table.toLocalIterator()], dtype=np.int64)) if few else None
    shared = spark.sparkContext.broadcast(known)

    def manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for text in b.column(1):
                data, raw = payload(text.as_py())
                ds, lens, own, at = [], [], [], 0
                for end in cut_points(data):
                    ds.append(digest(data[at:end]))
                    lens.append(end - at)
                    at = end
                if known is None:
                    is_shared = np.ones(len(ds), bool)
                elif len(known):
                    p = np.array([_prefix(d) for d in ds], np.int64)
                    is_shared = known[np.minimum(np.searchsorted(known, p), len(known) - 1)] == p
                else:
                    is_shared = np.zeros(len(ds), bool)
                at = 0
                for n, s in zip(lens, is_shared):
                    if not s:
                        own.append(data[at : at + n])
                    at += n
                head = wav_header(len(data))
                media = hashlib.sha256(head)
                media.update(data)
                for c, v in zip(cols, (raw, head, media.digest(), [d if s else None for d, s in zip(ds, is_shared)], lens, b"".join(own), bool(is_shared.any()))):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["id", "raw", "head", "sha", "refs", "lens", "own", "has_refs"])

    id_type = src.schema["id"].dataType.simpleString()
    made = src.mapInArrow(manifest, f"id {id_type}, raw long, head binary, sha binary, refs array<binary>, lens array<int>, own binary, has_refs boolean")
    made.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(f"{path}/manifests")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen: set[bytes] = set()
        for b in batches:
            out_d, out_c = [], []
            for text in b.column(0):
                data, _ = payload(text.as_py())
                at = 0
                ends = cut_points(data)
                ds = [digest(data[s:e]) for s, e in zip([0, *ends], ends)]
                if known is not None:
                    if not len(known):
                        continue
                    p = np.array([_prefix(d) for d in ds], np.int64)
                    hit = known[np.minimum(np.searchsorted(known, p), len(known) - 1)] == p
                else:
                    hit = [True] * len(ds)
                for d, e, h in zip(ds, ends, hit):
                    if h and d not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(d)
                        out_d.append(d)
                        out_c.append(data[at:e])
                    at = e
            yield pa.RecordBatch.from_arrays([pa.array(out_d, pa.binary()), pa.array(out_c, pa.binary())], names=["d", "bytes"])

    once = src.select("src").mapInArrow(bytes_of, "d binary, bytes binary").groupBy("d").agg(F.first("bytes").alias("bytes"))
    once.write.option("compression", "zstd").parquet(f"{path}/chunks")


def load(spark: SparkSession, path: str, derive: Callable[[bytes, int, bytes], tuple], derived: str, id_type: str = "long") -> DataFrame:
    """Read media back from their chunk lists and derive columns from each.

    derive gets (header + samples, length before padding, stored digest) and returns the values of the schema
    `derived`. Rows whose chunks are all their own are put together where they are read; the others join the chunk
    table by digest, each distinct chunk list once however many rows have it. A media whose digest differs from
    the stored one raises ValueError.
    """
    m = spark.read.parquet(f"{path}/manifests")
    n_out = len(pa_fields(derived))

    def build(head: bytes, own: bytes, refs, lens, parts: dict[int, bytes]) -> bytes:
        out, at = [head], 0
        for i, (d, n) in enumerate(zip(refs, lens)):
            if d is None:
                out.append(own[at : at + n])
                at += n
            else:
                out.append(parts[i])
        return b"".join(out)

    def finish(with_parts: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                get = {n: b.column(n) for n in b.schema.names}
                values = []
                for i in range(b.num_rows):
                    parts = {p["i"]: p["bytes"] for p in get["parts"][i].as_py()} if with_parts else {}
                    media = build(get["head"][i].as_py(), get["own"][i].as_py(), get["refs"][i].as_py(), get["lens"][i].as_py(), parts)
                    sha = get["sha"][i].as_py()
                    if hashlib.sha256(media).digest() != sha:
                        raise ValueError("stored media differ from what was written")
                    values.append(derive(media, get["raw"][i].as_py(), sha))
                kinds = pa_fields(derived)
                cols = [pa.array([v[k] for v in values], t) for k, (_, t) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[b.schema.names[0], *[n for n, _ in kinds]])

        return run

    assert n_out
    alone = m.where("not has_refs").select("id", "raw", "head", "sha", "refs", "lens", "own").mapInArrow(finish(False), f"id {id_type}, {derived}")
    # media that are equal have equal manifests: each is put together once, and rows take what it gave. Bytes of the
    # chunks that most media share, and what the most common media gave, are broadcast; others come by a join.
    joint = m.where("has_refs").withColumn("k", F.concat("sha", F.col("raw").cast("string").cast("binary")))
    first = stash(joint.groupBy("k").agg(F.min("row").alias("row"), F.count("*").alias("n")), "op10-media")
    reps = joint.join(first.select("row"), "row", "left_semi")
    wanted = reps.select("row", F.posexplode("refs").alias("i", "d")).where("d is not null")
    chunks = spark.read.parquet(f"{path}/chunks").join(wanted.groupBy("d").agg(F.count("*").alias("n")), "d")
    got = join_one(wanted, stash(chunks, "op10-wanted"), "d", "n", keys=HOT_CHUNKS).groupBy("row").agg(F.collect_list(F.struct("i", "bytes")).alias("parts"))
    built = reps.select("row", "k", "raw", "head", "sha", "refs", "lens", "own").join(got, "row").drop("row")
    done = built.mapInArrow(finish(True), f"k binary, {derived}")
    names = [n for n, _ in pa_fields(derived)]
    done = stash(done.join(first.select("k", "n"), "k"), "op10-done")
    rows = join_one(joint.select("id", "k"), done, "k", "n").select("id", *names)
    return alone.unionByName(rows)


def pa_fields(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}
    return [(n, kinds[t]) for n, t in (f.split() for f in schema.split(","))]


DERIVED = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def audio_digest(media: bytes, raw: int, sha: bytes) -> tuple:
    """Digests and features of 8-bit samples: mean, root mean square, zero crossings and the busiest of 8 bands."""
    data = media[44:]
    x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    levels = np.bincount((x + 128) >> 5, minlength=8)
    feature = f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};band={int(levels.argmax())};share={levels.max() / len(x):.4f}"
    return raw, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), sha.hex(), feature


def media_of_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text's payload as 8-bit mono WAV samples in chunks below path, read it back and digest it.

    Returns one row per input row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, all from the bytes read back. A null or empty text is 64 zero bytes. Null ids and
    repeated rows are rows like any other; equal texts get equal values; other columns are ignored; an empty table
    gives no rows.
    """
    store(df, id_col, text_col, path)
    out = load(df.sparkSession, path, audio_digest, DERIVED, df.schema[id_col].dataType.simpleString())
    return out.withColumnRenamed("id", id_col)
