"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint is cut into three segments of at most 23 bits. Two fingerprints with at most two
differing bits agree wholly on one segment (pigeonhole) and differ in at most two bits on the
next. The perfect Golay code of length 23 has exactly one codeword within three bits of every
word: if two words differ in two bits at most, some word is within one bit of both, so its
codeword is among the nearest codewords of either ball of radius one. A ball has one such
codeword or six, so a fingerprint has 3 to 18 keys (equal segment, codeword index of the next).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewatlas.llm.common import arrow_map, words, written
from reviewatlas.llm.components import connected

#: Fixed: generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
#: (shift, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Larger buckets are linked through words one bit away instead of by pairs.
PAIR_LIMIT = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the shingles of lower-cased (A-Z) words; repeats count. No word: 0."""
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    if len(w) <= shingle:
        digests = [xxhash.xxh64_digest(b" ".join(w), 42)]
    else:
        joined = b" ".join(w)
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_digest
        digests = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(digests), 1 << 16):
        part = np.frombuffer(b"".join(digests[i : i + (1 << 16)]), dtype=np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, body) of every row; body hashes the text, so rows that share a doc_id but not the text can be told apart."""

    def run(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), batch.column("body")], names=["doc_id", "fp", "body"])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("body"))
    return arrow_map(source, run, "doc_id long, fp long, body long")


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of each single bit, the error of least weight of each syndrome, and the 24 words of weight
    one at most."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    bits = np.array([remainder(1 << i) for i in range(23)], dtype=np.int64)
    leader = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        leader[bits[i]] = 1 << i
        for j in range(i):
            leader[bits[i] ^ bits[j]] = 1 << i | 1 << j
            for k in range(j):
                leader[bits[i] ^ bits[j] ^ bits[k]] = 1 << i | 1 << j | 1 << k
    return bits, leader, np.array([0, *(1 << i for i in range(23))], dtype=np.int64)


def codewords(segment: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(n, 24) indices (the upper 12 bits) of the codewords nearest to the words within one bit of each of n words."""
    bits, leader, ball = tables
    near = segment[:, None] ^ ball[None, :]
    syndrome = np.zeros_like(near)
    for i in range(23):
        syndrome ^= np.where(near >> i & 1, bits[i], 0)
    return (near ^ leader[syndrome]) >> 11


def golay_keys(fp: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct keys of each fingerprint."""
    part = [(fp >> np.int64(shift)) & np.int64((1 << width) - 1) for shift, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(part):
        code = np.sort(codewords(part[(i + 1) % 3], tables), axis=1)
        new = np.ones(code.shape, dtype=bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append((np.int64(i) << 34) | (exact[row] << 12) | code[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(key, fp, node) of the distinct fingerprints."""
    tables = golay_tables()

    def run(batch: pa.RecordBatch):
        fp, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
        for i in range(0, len(fp), 1 << 14):
            row, key = golay_keys(fp[i : i + (1 << 14)], tables)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i + row]), pa.array(node[i + row])], names=["key", "fp", "node"])

    return arrow_map(nodes, run, "key long, fp long, node long")


def links(nodes: DataFrame, max_bits: int = 2, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(u, v) between nodes whose fingerprints differ in at most ``max_bits`` (2 at most) bits, complete up to
    transitivity. ``nodes`` (fp, node): distinct fingerprints.

    Buckets of up to ``pair_limit`` fingerprints are joined and verified. The fingerprints of larger
    ones are grouped by every word within one bit of them: two share such a word exactly if they differ in
    two bits at most, and a word has at most 65 fingerprints around it, whatever the bucket's size.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys find up to two differing bits")
    keyed = _keyed(nodes)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "buckets")
    few = shared.where(F.col("n") <= pair_limit)
    a, b = few.select("key", F.col("fp").alias("f"), F.col("node").alias("u")), few.select("key", F.col("fp").alias("g"), F.col("node").alias("v"))
    near = F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= max_bits
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("f") < F.col("g")) & near).select("u", "v")

    many = shared.where(F.col("n") > pair_limit).select("fp", "node").distinct()
    reach = {0: "array(fp)", 1: None, 2: "transform(sequence(-1, 63), i -> if(i < 0, fp, fp ^ shiftleft(1L, i)))"}[max_bits]
    if reach is None:
        # one bit: the word is the fingerprint without that bit, so only neighbours share it
        reach = "transform(sequence(0, 63), i -> named_struct('w', fp & ~shiftleft(1L, i), 'i', i))"
    around = many.select("node", F.explode(F.expr(reach)).alias("word"))
    stars = around.groupBy("word").agg(F.collect_list("node").alias("members")).where("size(members) > 1")
    spokes = stars.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).where("u <> v")
    return pairs.union(spokes)


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id, body): documents linked at ``max_bits`` or fewer differing bits, and the
    smallest doc_id that is reachable, itself included.

    Null and empty texts have fingerprint zero and link like any other. Equal fingerprints are one node,
    so any number of copies is one row in the search. Repeated rows give repeated rows. A null doc_id
    takes the component of its fingerprint, and null if no row with an id has that fingerprint. Other
    columns of ``docs`` are ignored; an empty table gives none.
    """
    fps = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "nodes")
    roots = connected(links(nodes, max_bits))
    component = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(component, "fp", "left").select("doc_id", "fp", "component_id", "body")


def hex_digits(fp: Column) -> Column:
    """Sixteen lower-case digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
