"""License scans by a positional index of rare template words.

Templates are short licence notices and phrases. A first pass over all documents counts in how many each
template word occurs, so words can be told apart by rarity (IDF). The second pass looks up, in each file and
for each template whose key words the file has, the template's `RARE` rarest words that the file has; each
occurrence of a word points to the place where the template would begin (its position less the word's
position in the template). Where at least `SHARE` of these words agree on a place, give or take `SLACK`
words, the template is a candidate; its mandatory key phrases must then stand there word for word. The
score is the share of the template's words that stand in their places.

A base phrase is a template that is its own key phrase: all its words are looked up and must agree exactly,
so no place is lost. Only the template index and one number a template word are shipped; no text is shuffled.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased.

Nulls: a null text has no words; null ids are kept. Repeated rows each get a row. Texts are read whole and may
be of any length; one very long text is a batch by itself. Ties in rarity go by the word. Other columns are
left out. Empty table: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import read, text_batches, text_bytes

#: Words looked up for a template, share of them that must agree, how many words off they may be, text of a batch.
RARE, SHARE, SLACK, BATCH_BYTES = 6, 0.75, 2, 4 << 20
#: Bytes of words; A-Z become a-z, other ASCII a space.
TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: The base phrases and their labels.
BASE = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
#: Public licence notices in the words of a scan: label, notice, mandatory key phrases.
NOTICES = [
    ("agpl", "it under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["except in compliance with the license", "apache org licenses"]),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike", ["creative commons attribution sharealike"]),
    ("epl", "made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty"]),
]


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    base: bool

    @classmethod
    def of(cls, label: str, text: str, keys: list[str], base: bool = False) -> Template:
        return cls(label, tuple(text.encode().split()), tuple(tuple(k.encode().split()) for k in keys), base)


TEMPLATES = [*(Template.of(label, text, [text], True) for label, text in BASE), *(Template.of(*n) for n in NOTICES)]


class Index:
    """Templates by word: numbers of words (from 1), where each stands, and how rare it is."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], documents: int) -> None:
        self.templates = templates
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for t in templates for w in t.words}))}
        rarity = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in self.number}
        self.ids = [np.array([self.number[w] for w in t.words]) for t in templates]
        self.keys = [[np.array([self.number[w] for w in k]) for k in t.keys] for t in templates]
        #: Each template's words, the rarest first, with their positions.
        self.rarest = [[(self.number[w], np.flatnonzero(ids == self.number[w])) for w in sorted(set(t.words), key=lambda w: (-rarity[w], w))] for t, ids in zip(templates, self.ids, strict=True)]
        self.needed = np.zeros((len(templates), len(self.number) + 1), np.int32)
        for row, keys in zip(self.needed, self.keys, strict=True):
            row[np.concatenate(keys)] = 1


class Lookup(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class Files:
    """The template words of a run of files: `ids` at all positions, a zero after each file."""

    def __init__(self, texts: list[bytes], number: dict[bytes, int]) -> None:
        get = Lookup(number).__getitem__
        own = [words(t) for t in texts]
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + 1)])
        self.ids = np.zeros(self.starts[-1], np.int32)
        for at, w in zip(self.starts.tolist(), own, strict=False):
            self.ids[at : at + len(w)] = np.fromiter(map(get, w), np.int32, len(w))
        at = np.flatnonzero(self.ids)
        order = np.argsort(self.ids[at], kind="stable")
        self.places = at[order]
        self.begin = np.searchsorted(self.ids[self.places], np.arange(len(number) + 2))
        self.has = np.zeros((len(texts), len(number) + 1), bool)
        self.has[np.searchsorted(self.starts, at, side="right") - 1, self.ids[at]] = True

    def postings(self, file: int, word: int) -> np.ndarray:
        """Where a word stands in a file."""
        own = self.places[self.begin[word] : self.begin[word + 1]]
        return own[slice(*np.searchsorted(own, self.starts[file : file + 2]))]

    def stands(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Those of the places (of one file) at which the words stand one after the other."""
        at = at[(at >= 0) & (at + len(ids) <= len(self.ids))]
        for i, word in enumerate(ids):
            at = at[self.ids[at + i] == word]
        return at


def near(sorted_places: np.ndarray, x: np.ndarray, slack: int) -> np.ndarray:
    """Whether each x has a place within `slack`."""
    return np.searchsorted(sorted_places, x + slack, side="right") > np.searchsorted(sorted_places, x - slack)


def placed(files: Files, file: int, index: Index, k: int) -> list[tuple[int, float]]:
    """(start, score) of the places of template k in a file."""
    template, ids = index.templates[k], index.ids[k]
    low, high = files.starts[file], files.starts[file + 1] - 1
    looked = [(files.postings(file, w), offsets) for w, offsets in index.rarest[k] if files.has[file, w]]
    looked = looked if template.base else looked[:RARE]
    pointed = [np.unique((own[:, None] - offsets[None]).reshape(-1)) for own, offsets in looked]
    slack = 0 if template.base else SLACK
    starts = pointed[0] if template.base else np.unique(np.concatenate(pointed))
    votes = sum(near(p, starts, slack).astype(np.int64) for p in pointed)
    starts = starts[votes >= (len(looked) if template.base else max(2, math.ceil(SHARE * len(looked))))]
    if template.base:
        return [(int(s - low), 1.0) for s in files.stands(starts, ids)]
    for key in index.keys[k]:
        anchor = min(((files.postings(file, w) - i) for i, w in enumerate(key)), key=len)
        stands = files.stands(anchor, key)
        # within the template's reach at this place
        starts = starts[np.searchsorted(stands, starts + len(ids) - len(key) + slack, side="right") > np.searchsorted(stands, starts - slack)]
    if not len(starts):
        return []
    share = np.zeros(len(starts))
    for offset, w in enumerate(ids):
        if files.has[file, w]:
            share += near(files.postings(file, w), starts + offset, slack)
    return [(int(max(s, low) - low), float(x)) for s, x in zip(starts, share / len(ids), strict=True) if s < high]


def document_frequency(documents: DataFrame, templates: list[Template]) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, and how many documents there are."""
    number = {w: i for i, w in enumerate(sorted({w for t in templates for w in t.words}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(number) + 1, np.int64), 0
        for batch in text_batches(batches, BATCH_BYTES):
            for text in text_bytes(batch):
                for w in number.keys() & set(words(text)):
                    total[number[w]] += 1
            rows += batch.num_rows
        total[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total, pa.int64())], names=["word", "n"])

    rows = documents.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r.word: r.n for r in rows}
    return {w: found.get(i, 0) for w, i in number.items()}, found.get(len(number), 0)


PLACE = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("score", pa.float64()), ("base", pa.bool_())])


def find_licences(documents: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """(doc_id, n_words, places): places as structs (start, words, label, score, base) by start, then template."""
    templates = TEMPLATES if templates is None else templates
    frequency, total = document_frequency(documents, templates)
    shared = documents.sparkSession.sparkContext.broadcast(Index(templates, frequency, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        wanted = index.needed.sum(1)
        for batch in text_batches(batches, BATCH_BYTES):
            files = Files(text_bytes(batch), index.number)
            found: list[list] = [[] for _ in range(batch.num_rows)]
            for file, k in np.argwhere(files.has.astype(np.int32) @ index.needed.T == wanted).tolist():
                t = index.templates[k]
                found[file].extend({"start": s, "words": len(t.words), "label": t.label, "score": x, "base": t.base} for s, x in placed(files, file, index, k))
            for own in found:
                own.sort(key=lambda p: p["start"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files.sizes, pa.int64()), pa.array(found, pa.list_(PLACE))], names=["doc_id", "n_words", "places"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_words long, places array<struct<start:long,words:long,label:string,score:double,base:boolean>>")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licences(read(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("places")).alias("labels"), score.alias("score"))
