"""License notices in documents by an exact set-similarity join of text blocks with templates.

Template words are ordered by their frequency in all documents, rarest first. A block whose overlap with a template
reaches the threshold must hold one of the template's first |T| - o + 1 words (o: the overlap that is needed) among its
own first |B| - o + 1, must hold o template words at all, and must have enough words left behind the place where the two
meet: prefix, length and positional filters leave few pairs, and these are verified. None that meets the threshold is lost.

The templates are a dictionary that the caller holds, so the index goes to the tasks and documents are never shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Wordings of public license notices, and their labels.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]
#: Share of a template's distinct words that a block must hold; below 20 distinct words that is all of them.
CONTAINMENT = 0.95
#: Bytes of templates and phrases at most; they are a dictionary that every task holds, not a table that grows with documents.
MAX_BYTES = 32_000_000
#: Bytes of a text that are words at once; of the whole text only numbers of words are held.
SLICE = 4_000_000
#: Bytes to words: A-Z in lower case; letters, digits and all from 0x80 make words, the others part them.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
FOUND = "n_words long, places array<struct<label: string, word: long>>, found array<struct<label: string, template: int, begin: long, end: long, containment: double>>"


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER).split()


def numbered(raw: bytes | None, number: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, -1 for words without one."""
    clean, at, out = (raw or b"").translate(LOWER), 0, [np.zeros(0, dtype=np.int32)]
    while at < len(clean):
        cut = clean.find(b" ", at + SLICE)
        cut = len(clean) if cut < 0 else cut
        found = clean[at:cut].split()
        out.append(np.fromiter(map(number.get, found, repeat(-1)), dtype=np.int32, count=len(found)))
        at = cut
    return np.concatenate(out)


def needed(distinct: int, containment: float) -> int:
    return max(1, ceil(Fraction(str(containment)) * distinct))


def widths(templates: list[tuple[str, str]]) -> list[int]:
    """Half the block length of each template: the least power of two from 8 that holds its words, or those of a template that has all its words."""
    sets = [set(words(t)) for _, t in templates]
    own = [max(8, 1 << (len(words(t)) - 1).bit_length()) for _, t in templates]
    return [max(own[k] for k in range(len(sets)) if sets[i] <= sets[k]) for i in range(len(sets))]


class Index:
    """Templates as sorted word numbers, and for each block width the templates whose prefix holds a word."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], counts: dict[bytes, int], containment: float):
        vocabulary = {w for _, t in templates for w in words(t)} | {w for p, _ in phrases for w in words(p)}
        order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
        self.number = {w: i for i, w in enumerate(order)}
        self.phrases = [(np.array([self.number[w] for w in words(p)], dtype=np.int32), label) for p, label in phrases if words(p)]
        self.sets, self.labels = [sorted({self.number[w] for w in words(t)}) for _, t in templates], [label for label, _ in templates]
        self.need = [needed(len(s), containment) for s in self.sets]
        self.above = [{k for k, s in enumerate(self.sets) if set(t) < set(s)} for t in self.sets]
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, w in enumerate(widths(templates)):
            for i, word in enumerate(self.sets[t][: len(self.sets[t]) - self.need[t] + 1]):
                self.postings[w][word].append((t, i))
        self.postings = {w: dict(p) for w, p in self.postings.items()}
        self.starts = {}
        for w, postings in self.postings.items():
            self.starts[w] = np.zeros(len(order) + 1, dtype=bool)  # the last one is that of -1
            self.starts[w][list(postings)] = True

    def places(self, ids: np.ndarray) -> list[dict]:
        """Where the phrases stand, by word."""
        out = []
        for phrase, label in self.phrases:
            at = np.flatnonzero(ids == phrase[0])
            for k in range(1, len(phrase)):
                at = at[at + k < len(ids)]
                at = at[ids[at + k] == phrase[k]]
            out += [{"label": label, "word": p} for p in at.tolist()]
        return sorted(out, key=lambda p: (p["word"], p["label"]))

    def joined(self, block: list[int], postings: dict[int, list[tuple[int, int]]]) -> list[tuple[int, float]]:
        """(template, containment) of all templates of a width whose threshold a block of sorted distinct word numbers meets."""
        met: dict[int, int] = Counter()
        for j, word in enumerate(block):
            for t, i in postings.get(word, ()):
                need, size = self.need[t], len(self.sets[t])
                # outside the block's prefix, or too few words behind both places
                if j > len(block) - need or met[t] + 1 + min(size - i - 1, len(block) - j - 1) < need:
                    continue
                met[t] += 1
        out = []
        for t in met:
            overlap = len(set(self.sets[t]).intersection(block)) if met[t] else 0
            if overlap >= self.need[t]:
                out.append((t, overlap / len(self.sets[t])))
        return out

    def found(self, ids: np.ndarray) -> list[dict]:
        """Blocks that meet a template; a template goes where one that has all its words and more meets the same block."""
        out = []
        for w, postings in self.postings.items():
            hits = np.flatnonzero(self.starts[w][ids]) // w
            blocks = np.unique(np.concatenate([hits, hits - 1]))
            for b in blocks[blocks >= 0].tolist():
                held = np.unique(ids[b * w : (b + 2) * w])
                pairs = self.joined(held[held >= 0].tolist(), postings)
                at_once = {t for t, _ in pairs}
                out += [{"label": self.labels[t], "template": t, "begin": b * w, "end": min((b + 2) * w, len(ids)), "containment": c} for t, c in pairs if not self.above[t] & at_once]
        return sorted(out, key=lambda m: (m["begin"], m["template"]))


def frequencies(docs: DataFrame, text_col: str, vocabulary: list[bytes]) -> dict[bytes, int]:
    """How often each word of a vocabulary stands in all documents; tasks add up before the shuffle."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()):
                ids = numbered(raw.as_py(), number)
                total += np.bincount(ids[ids >= 0], minlength=len(number))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {vocabulary[r.word]: r.n for r in counted.collect()}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: list[tuple[str, str]] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, found) of every row: where phrases stand, and blocks that meet templates.

    templates are (label, text), phrases (text, label); both have at most MAX_BYTES. Blocks are 2 w words at every w-th word,
    w a power of two that holds the template, so that each passage of a template's length lies in a block whole.
    Containment is over distinct words in any order. Null and empty texts have no words and no blocks, very long texts are
    read in slices that end between words, repeated rows and ids each keep their row, an empty table gives no rows, other
    columns are ignored. Templates without words never match.
    """
    templates = [t for t in (NOTICES if templates is None else templates) if words(t[1])]
    phrases = PHRASES if phrases is None else phrases
    if sum(len(a.encode()) + len(b.encode()) for a, b in [*templates, *phrases]) > MAX_BYTES:
        raise ValueError(f"templates and phrases of more than {MAX_BYTES} bytes: scan them in parts")
    vocabulary = sorted({w for _, t in templates for w in words(t)} | {w for p, _ in phrases for w in words(p)})
    index = Index(templates, phrases, frequencies(docs, text_col, vocabulary), containment)
    fields = [f"doc_id {dict(docs.dtypes)[id_col]}", FOUND]
    place, match = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places, found = [], [], []
            for raw in batch.column("text").cast(pa.binary()):
                ids = numbered(raw.as_py(), index.number)
                n.append(len(ids))
                places.append(index.places(ids))
                found.append(index.found(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, place), pa.array(found, match)], names=["doc_id", "n_words", "places", "found"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join(fields))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    label = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in of]))), ",")
    starts = F.transform("places", lambda p: p["word"])
    best = F.coalesce(F.array_max(F.transform("found", lambda m: m["containment"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label("places").alias("base_labels"), label("places", "found").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


def license_sql(templates: list[tuple[str, str]] = NOTICES, phrases: list[tuple[str, str]] = PHRASES, containment: float = CONTAINMENT) -> str:
    """The same by joining all blocks with all templates on every word: no order of words, no filters."""
    sets = [{w.decode() for w in words(t)} for _, t in templates]
    heads = ", ".join(f"({i}, '{label}', {w}, {len(s)}, {needed(len(s), containment)})" for i, ((label, _), w, s) in enumerate(zip(templates, widths(templates), sets, strict=True)))
    tokens = ", ".join(f"({i}, '{w}')" for i, s in enumerate(sets) for w in sorted(s))
    above = ", ".join(f"({i}, {k})" for i, s in enumerate(sets) for k, o in enumerate(sets) if s < o) or "(-1, -1)"
    asked = ", ".join(f"('{label}', {[w.decode() for w in words(p)]})" for p, label in phrases)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9\x{{80}}-\x{{10FFFF}}]', ' ', 'g'), '[^ ]+') AS raw FROM documents
), t AS (
  SELECT row, doc_id, list_transform(raw, lambda w: translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS words FROM d
), tokens(template, word) AS (VALUES {tokens}), heads(template, label, w, size, need) AS (VALUES {heads}), above(template, over) AS (VALUES {above}), phrases(label, phrase) AS (VALUES {asked}),
e AS (SELECT row, unnest(words) AS word, unnest(range(len(words))) AS p FROM t),
base AS (
  SELECT e.row, e.p, f.label FROM e JOIN phrases f ON e.word = f.phrase[1] JOIN t ON t.row = e.row WHERE t.words[e.p + 1 : e.p + len(f.phrase)] = f.phrase
), known AS (SELECT DISTINCT row, word, w, b FROM (SELECT row, word, w, unnest([p // w, p // w - 1]) AS b FROM e, (SELECT DISTINCT w FROM heads) WHERE word IN (SELECT word FROM tokens)) WHERE b >= 0),
met AS (
  SELECT k.row, k.b, h.template, h.label, count(*) / CAST(h.size AS DOUBLE) AS containment FROM known k JOIN tokens x ON x.word = k.word JOIN heads h ON h.template = x.template AND h.w = k.w
  GROUP BY k.row, k.b, h.template, h.label, h.size, h.need HAVING count(*) >= h.need
), kept AS (
  SELECT * FROM met m WHERE NOT EXISTS (SELECT 1 FROM above a JOIN met o ON o.template = a.over WHERE a.template = m.template AND o.row = m.row AND o.b = m.b)
), b AS (SELECT row, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY row),
m AS (SELECT row, max(containment) AS best FROM kept GROUP BY row),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT row, label FROM base UNION ALL SELECT row, label FROM kept) GROUP BY row)
SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(m.best, 0.0) END AS score
FROM t LEFT JOIN b ON b.row = t.row LEFT JOIN m ON m.row = t.row LEFT JOIN a ON a.row = t.row
"""


OP11_SQL = license_sql()
