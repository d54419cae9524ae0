"""SimHash near-duplicates by anchor-point covering.

Fingerprints: 64 bits over XXH64 (seed 42) of word shingles. Links: fingerprints that differ in at most three bits.
Anchors are the words of a covering code: the 64 bits are cut into an even number of odd-length blocks, each covered
perfectly by its repetition code (all zeros, all ones; radius (length-1)/2). A fingerprint's home anchor is the
block-wise majority. It is also copied to each larger anchor it exceeds the block radii of by at most three in all:
by the triangle inequality that set holds the home of every fingerprint within three bits, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.blocks import split_hot
from tallyforge.llm.common import by_key, forget, save, table, words_of
from tallyforge.llm.graph import components

BITS = 64
#: Rows of an anchor beyond which it is split into parts that meet pairwise.
PART_ROWS = 40_000


def fingerprint(raw: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of UTF-8 text as a signed 64-bit integer; text without words has zero."""
    words = words_of(raw)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, 4096):
        bits = np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; texts are read whole, null as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in b.column(1)), dtype=np.int64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def code_blocks(n_fps: int) -> list[int]:
    """Odd block lengths that sum to 64: more and shorter blocks, hence more anchors, for more fingerprints."""
    b = min(20, max(6, 2 * round(log2(max(n_fps, 1) / 256 + 1) / 2)))
    lengths, left = [], BITS
    for i in range(b, 0, -1):
        size = left // i
        size -= size % 2 == 0
        lengths.append(max(1, size))
        left -= lengths[-1]
    i = 0
    while left > 0:
        lengths[i % b] += 2
        left -= 2
        i += 1
    return lengths


def anchors_of(fps: np.ndarray, lengths: list[int], threshold: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (index into fps, anchor, home 0/1): each fingerprint at its home and at the larger anchors it must meet."""
    bits = np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = np.cumsum([0, *lengths])
    ones = np.stack([bits[:, a:z].sum(axis=1) for a, z in zip(ends[:-1], ends[1:], strict=True)], axis=1).astype(np.int64)
    size = np.array(lengths)
    major = ones * 2 > size
    home = (major << np.arange(len(lengths))).sum(axis=1).astype(np.int64)
    near = np.where(major, size - ones, ones)
    excess = (size - near) - (size - 1) // 2
    index = np.arange(len(fps))
    out = [(index, home, np.ones(len(fps), dtype=np.int8))]
    for r in range(1, threshold + 1):
        for flip in combinations(range(len(lengths)), r):
            mask = sum(1 << i for i in flip)
            other = home ^ mask
            hit = np.flatnonzero((excess[:, flip].sum(axis=1) <= threshold) & (other > home))
            if len(hit):
                out.append((index[hit], other[hit], np.zeros(len(hit), dtype=np.int8)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def replicate(fps: DataFrame, lengths: list[int], threshold: int = 3) -> DataFrame:
    """(anchor, fp, home) rows of distinct fingerprints (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_fps = b.column(0).to_numpy()
            for a in range(0, len(all_fps), 2048):
                part = all_fps[a : a + 2048]
                i, anchor, home = anchors_of(part, lengths, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[i]), pa.array(home)], names=["anchor", "fp", "home"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long, home byte")


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For n nodes and links left-right, the smallest node of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def links(rows: DataFrame, threshold: int = 3) -> DataFrame:
    """Edges (u, v) that connect all fingerprints of an anchor which differ in at most threshold bits.

    Each group compares its home fingerprints with all others in slices and returns a spanning star of each of its
    local components, so a group of n rows returns fewer than n edges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in by_key(batches, ["anchor", "lo", "hi"]):
            fp = group.column("fp").to_numpy()
            fp, first = np.unique(fp, return_index=True)
            home = np.flatnonzero(group.column("home").to_numpy()[first])
            if not len(home) or len(fp) < 2:
                continue
            bits, label = fp.view(np.uint64), np.arange(len(fp))
            step = max(1, 2_000_000 // len(fp))
            for a in range(0, len(home), step):
                h = home[a : a + step]
                near = np.bitwise_count(bits[h][:, None] ^ bits[None, :]) <= threshold
                i, j = np.nonzero(near)
                i = h[i]
                keep = i != j
                if keep.any():
                    label = roots(len(fp), np.concatenate([i[keep], np.arange(len(fp))]), np.concatenate([j[keep], label]))
            moved = np.flatnonzero(label != np.arange(len(fp)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])], names=["u", "v"])

    return rows.repartition("anchor", "lo", "hi").sortWithinPartitions("anchor", "lo", "hi").select("anchor", "lo", "hi", "fp", "home").mapInArrow(run, "u long, v long")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, threshold: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs.

    component_id is the smallest id reachable over links of fingerprints with at most threshold differing bits.
    Documents with the same fingerprint, repeated rows and texts without words (fingerprint zero) included, are one
    class; a null id takes part but names no component unless its whole component has null ids. Empty tables give no
    rows; other columns are ignored.
    """
    prints = save(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    lengths = code_blocks(classes.count())
    rows = split_hot(replicate(classes, lengths, threshold), ["anchor"], "fp", PART_ROWS)
    edges = save(links(rows, threshold), "links")
    comp = components(edges)
    named = classes.join(comp, classes.fp == comp.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    # written before the join: a hot fingerprint's partition of prints can then be split (spark.sql.adaptive.skewJoin)
    by_fp = save(named.join(least, "component").select("fp", "component_id"), "by_fp")
    out = prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")
    forget(classes)
    forget(edges)
    return out


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
