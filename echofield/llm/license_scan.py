"""Licence scan with a positional index of rare words.

Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.

* Phrases. Each word of a phrase is looked up in a table of licence words; a phrase
  stands where its words' positions, shifted by their places in the phrase, meet.
* Passages. The templates are paragraphs of public licence texts and of the notices that
  name them. Each passage's anchors are its places with the highest inverse document
  frequencies over the corpus, as many as weigh more than what may disagree, so a place
  where enough of the passage stands has at least one of them. Each anchor in a file is
  looked up in the postings of the passages. Position in the file less position in the
  passage gives an offset, where the passage is a candidate. Words that were added or left
  out make the offsets of what follows drift, so offsets within DRIFT of each other are
  one candidate: it is aligned in order within that band, and counts if enough of it agrees
  (all but one word of a short one) and one of the licence's key phrases in it stands, but for one word at most and no
  essential one. Words that only stand apart in a licence of the same kind have to be joined.

Defined results: a null text is empty. A file without words has n_words 0, no places and
score 0. score is the share of a passage's weight that agrees, at best, and 1 for a
phrase. Repeated rows get equal results. An empty table gives an empty result. Only
doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import Words, portions

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Paragraphs of public licence texts and notices, by label, in words.
NOTICES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an"
        " as is basis without warranties or conditions of any kind either express or implied see the license for the specific"
        " language governing permissions and limitations under the license",
    ),
    "gpl-2.0": (
        "this work is licensed under the gnu general public license version 2",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-3.0": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
        " as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public"
        " license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    "agpl": (
        "licensed under the gnu affero general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "mpl-2.0": (
        "subject to the terms of the mozilla public license v 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed"
        " with this file you can obtain one at",
    ),
    "epl": (
        "made available under the terms of the eclipse public license",
        "this program and the accompanying materials are made available under the terms of the eclipse public license",
    ),
    "boost": (
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying"
        " documentation covered by this license the software to use reproduce display distribute execute and transmit the software"
        " and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"
        " all subject to the following",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"
        " in the documentation and or other materials provided with the distribution",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or"
        " consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits"
        " or business interruption however caused and on any theory of liability whether in contract strict liability or tort"
        " including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility"
        " of such damage",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
        " that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied"
        " warranties of merchantability and fitness",
    ),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files the software to deal in the software without restriction including without limitation the rights to use copy modify"
        " merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties"
        " of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders"
        " be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of"
        " or in connection with the software or the use or other dealings in the software",
    ),
    "mit-notice": ("released under the mit license",),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any"
        " damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and"
        " redistribute it freely subject to the following restrictions",
    ),
    "cc-by-nc": ("licensed under cc by nc 4 0",),
    "cc-by-sa": ("licensed under cc by sa 4 0",),
    "cc-by-4.0": ("licensed under cc by 4 0",),
    "cc0": ("released under cc0 1 0 universal public domain dedication",),
    "public-domain": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled"
        " binary for any purpose commercial or non commercial and by any means",
    ),
    "wtfpl": ("everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",),
}

# Of those that a passage holds, one must stand in the text.
KEY_PHRASES = {
    "apache-2.0": ["apache license version 2 0", "without warranties or conditions of any kind"],
    "gpl-2.0": ["general public license version 2", "either version 2 of the license"],
    "gpl-3.0": ["general public license version 3", "either version 3 of the license"],
    "lgpl": ["lesser general public license"],
    "agpl": ["affero general public license"],
    "mpl-2.0": ["mozilla public license"],
    "epl": ["eclipse public license"],
    "boost": ["boost software license", "any person or organization obtaining a copy"],
    "bsd": ["source and binary forms", "redistributions of source code must retain", "redistributions in binary form must reproduce", "procurement of substitute goods or services"],
    "isc": ["with or without fee is hereby granted", "the author disclaims all warranties"],
    "mit-text": ["hereby granted free of charge", "all copies or substantial portions of the software", "the authors or copyright holders be liable"],
    "mit-notice": ["the mit license"],
    "zlib": ["in no event will the authors be held liable", "alter it and redistribute it freely"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-sa": ["cc by sa"],
    "cc-by-4.0": ["cc by 4 0"],
    "cc0": ["cc0 1 0"],
    "public-domain": ["unencumbered software", "copy modify publish use compile sell or distribute"],
    "wtfpl": ["copy and distribute verbatim or modified copies"],
}

# Words of key phrases that may not be missing, as they tell licences apart.
ESSENTIAL = {
    "apache-2.0": ("apache",), "gpl-2.0": ("2",), "gpl-3.0": ("3",), "lgpl": ("lesser",), "agpl": ("affero",), "mpl-2.0": ("mozilla",), "epl": ("eclipse",),
    "boost": ("boost", "organization"), "bsd": (), "isc": ("fee", "disclaims"), "mit-text": (), "mit-notice": ("the", "mit", "license"), "zlib": (),
    "cc-by-nc": ("cc", "by", "nc"), "cc-by-sa": ("cc", "by", "sa"), "cc-by-4.0": ("cc", "by", "4"), "cc0": ("cc0",), "public-domain": ("unencumbered",), "wtfpl": (),
}

# Words that must stand beside each other, as others of the kind have one between.
JOINED = {"gpl-2.0": ("gnu", "general"), "gpl-3.0": ("gnu", "general"), "cc-by-4.0": ("by", "4")}

#: Words by which a passage's places in a file may drift apart, to either side.
DRIFT = 4
#: The share of a passage's weight to agree.
LEAST_SHARE = 0.8


class FileWords(Words):
    """Words as this scan takes them; A-Z are lower-cased."""

    def __init__(self, texts: list[bytes]):
        self.raw = LOWER[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
        self.space = ~LETTER[self.raw]
        lengths = np.array([len(x) + 1 for x in texts], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[48:58] = LETTER[97:123] = LETTER[128:] = True

PHRASE_WORDS = [x.split() for x in PHRASES]
PASSAGES = [(label, text.split()) for label, texts in NOTICES.items() for text in texts]
VOCABULARY = sorted({w for x in [*PHRASE_WORDS, *(words for _, words in PASSAGES)] for w in x})
NUMBER = {w: k for k, w in enumerate(VOCABULARY)}
NUMBERS = [np.array([NUMBER[w] for w in words]) for _, words in PASSAGES]


def _phrase_places(passage: int) -> list[tuple[int, int]]:
    """(first, last + 1) place of each key phrase in a passage."""
    label, words = PASSAGES[passage]
    phrases = [x.split() for x in KEY_PHRASES[label]]
    return [(k, k + len(p)) for p in phrases for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]


KEYS = [_phrase_places(k) for k in range(len(PASSAGES))]


class Index:
    """Numbers of licence words in laid-out texts; -1 for other words."""

    def __init__(self):
        padded = [w.encode()[:16].ljust(16, b"\0") for w in VOCABULARY]
        self.first = np.array([int.from_bytes(w[:8], "little") for w in padded], np.uint64)
        self.second = np.array([int.from_bytes(w[8:], "little") for w in padded], np.uint64)
        self.size = np.array([len(w.encode()) for w in VOCABULARY])
        self.hashes = [laid_hash(FileWords([w.encode()]))[0] for w in VOCABULARY]
        order = np.argsort(np.array(self.hashes, np.uint64))
        self.sorted, self.order = np.array(self.hashes, np.uint64)[order], order

    def numbers(self, laid: FileWords, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        hashes = laid_hash(laid, starts, stops)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        found = np.where(self.sorted[at] == hashes, self.order[at], -1)
        # Hashes cover 16 bytes; longer words are decided on their bytes.
        for k in np.flatnonzero((found >= 0) & (stops - starts > 16)).tolist():
            if laid.raw[starts[k] : stops[k]].tobytes() != VOCABULARY[found[k]].encode():
                found[k] = -1
        short = np.flatnonzero((found >= 0) & (stops - starts <= 16))
        raw = np.concatenate([laid.raw, np.zeros(16, np.uint8)])
        each = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        size = stops[short] - starts[short]
        same = (each[starts[short]] & MASKS[np.minimum(size, 8)]) == self.first[found[short]]
        same &= (each[starts[short] + 8] & MASKS[np.clip(size - 8, 0, 8)]) == self.second[found[short]]
        found[short[~(same & (size == self.size[found[short]]))]] = -1
        return found


MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def laid_hash(laid: FileWords, starts: np.ndarray | None = None, stops: np.ndarray | None = None) -> np.ndarray:
    """A hash of each word, by its first 16 bytes and its length."""
    if starts is None or stops is None:
        starts, stops = laid.words()
    raw = np.concatenate([laid.raw, np.zeros(16, np.uint8)])
    each = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    size = stops - starts
    first = each[starts] & MASKS[np.minimum(size, 8)]
    second = each[starts + 8] & MASKS[np.clip(size - 8, 0, 8)]
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ second * np.uint64(0xC2B2AE3D27D4EB4F) ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(31)


_index: list[Index] = []


def _laid(texts: list[bytes]):
    if not _index:
        _index.append(Index())
    laid = FileWords(texts)
    starts, stops = laid.words()
    numbers = _index[0].numbers(laid, starts, stops)
    bounds = np.searchsorted(starts, np.concatenate([laid.begins, laid.ends[-1:]]))
    return laid, starts, stops, numbers, bounds


def _texts(column: pa.Array) -> list[bytes]:
    return [(x.as_py() or "").encode("utf-8", "replace") for x in column]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(len(VOCABULARY), np.int64), 0
    for batch in batches:
        for part in portions(_texts(batch.column(0))):
            _, _, _, numbers, bounds = _laid(part)
            hits = np.flatnonzero(numbers >= 0)
            text = np.searchsorted(bounds, hits, "right") - 1
            seen = np.unique(text * len(VOCABULARY) + numbers[hits])
            total += np.bincount(seen % len(VOCABULARY), minlength=len(VOCABULARY))
            documents += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(VOCABULARY)), -1)), pa.array(np.append(total, documents))], names=["word", "n"])


def inverse_frequencies(docs: DataFrame) -> list[float]:
    """The inverse document frequency of each licence word over all documents."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {x["word"]: x["n"] for x in rows}  # a row for each licence word
    n = counts.get(-1, 0)
    return [math.log((n + 1) / (counts.get(k, 0) + 1)) + 1 for k in range(len(VOCABULARY))]


Postings = dict[int, list[tuple[int, int]]]


def anchors(weights: list[float]) -> Postings:
    """(passage, place) of the anchors of all passages, by word.

    An offset at which no anchor of a passage agrees has less than LEAST_SHARE of it, and
    lacks two words at least.
    """
    postings: Postings = defaultdict(list)
    for passage, numbers in enumerate(NUMBERS):
        each = numbers.tolist()
        spare, held = (1 - LEAST_SHARE) * sum(weights[k] for k in each) * (1 + 1e-9), 0.0
        for n, place in enumerate(sorted(range(len(each)), key=lambda k: (-weights[each[k]], each[k], k))):
            postings[each[place]].append((passage, place))
            held += weights[each[place]]
            if held > spare and n:
                break
    return dict(postings)


def notices(numbers: np.ndarray, text: np.ndarray, weights: list[float], postings: Postings) -> dict[int, dict[str, float]]:
    """By text: labels of the passages in it, with the share of their weight that agrees.

    numbers and text hold a number for each word, -1 for other words, and its text.
    """
    each, at = np.array(weights), np.zeros(len(VOCABULARY) + 1, bool)
    at[list(postings)] = True
    candidates: dict[int, list[np.ndarray]] = defaultdict(list)
    hits = np.flatnonzero(at[numbers])
    if not len(hits):
        return {}
    order = np.argsort(numbers[hits], kind="stable")
    words, firsts = np.unique(numbers[hits][order], return_index=True)
    for word, own in zip(words.tolist(), np.split(hits[order], firsts[1:]), strict=True):
        for passage, place in postings[word]:
            candidates[passage].append((own - place) * (len(text) + 1) + text[own])  # with its text, as an offset can be before it
    found: dict[int, dict[str, float]] = defaultdict(dict)
    margin = max(map(len, NUMBERS)) + 2 * DRIFT + 1
    padded = np.concatenate([np.full(DRIFT, -1), numbers, np.full(margin, -1)])
    of = np.concatenate([np.full(DRIFT, -1), text, np.full(margin, -1)])
    for passage, keys in candidates.items():
        label, wanted = PASSAGES[passage][0], NUMBERS[passage]
        both = np.unique(np.concatenate(keys))
        offsets, texts = _near(both // (len(text) + 1), both % (len(text) + 1))
        heavy = each[wanted]
        band = np.arange(len(wanted))[:, None] + np.arange(-DRIFT, 2 * DRIFT + 1)
        for k in range(0, len(offsets), 1 << 12):
            own = slice(k, k + (1 << 12))
            # Before the first word there is nothing; the margins stand for it.
            here = np.maximum(offsets[own, None, None] + band + DRIFT, 0)
            agree = (padded[here] == wanted[:, None]) & (of[here] == texts[own, None, None])
            seen = agree.any(axis=2)
            able = np.flatnonzero((seen @ heavy >= LEAST_SHARE * heavy.sum() * (1 - 1e-9)) | (seen.sum(axis=1) >= len(wanted) - 1))
            able = able[_keyed(agree[able], passage)]
            share = _aligned(agree[able], heavy) / heavy.sum()
            words = _aligned(agree[able], np.ones(len(wanted)))
            for j, value, held in zip(able.tolist(), share.tolist(), words.tolist(), strict=True):
                # In a short notice one word may weigh more than what may disagree.
                if value >= LEAST_SHARE or held >= len(wanted) - 1:
                    mine = found[int(texts[k + j])]
                    mine[label] = max(value, mine.get(label, 0.0))
    return found


def _near(offsets: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each run of offsets of a text that are within DRIFT of it."""
    order = np.lexsort((offsets, texts))
    offsets, texts = offsets[order], texts[order]
    kept = []
    for k in range(len(offsets)):
        if not kept or texts[k] != texts[kept[-1]] or offsets[k] > offsets[kept[-1]] + DRIFT:
            kept.append(k)
    return offsets[kept], texts[kept]


def _aligned(agree: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The most weight that agrees in order: by candidate, of places and drifts.

    A word that the file lacks moves what follows one drift back, an added one moves it
    one on, and a changed one leaves it where it is.
    """
    best = np.zeros((agree.shape[0], agree.shape[2]))
    for place, weight in enumerate(heavy):
        then = best + agree[:, place] * weight
        then[:, :-1] = np.maximum(then[:, :-1], best[:, 1:])
        best = np.maximum.accumulate(then, axis=1)
    return best.max(axis=1, initial=0)


def _keyed(agree: np.ndarray, passage: int) -> np.ndarray:
    """Whether one of the passage's key phrases stands, but for one word that isn't essential."""
    label, words = PASSAGES[passage]
    stands = np.zeros(len(agree), bool)
    for a, b in KEYS[passage]:
        needed = np.array([w in ESSENTIAL[label] for w in words[a:b]])
        part = agree[:, a:b]
        for shift in (0, 1, -1):  # one word may be added within, or be missing
            moved = part.copy()
            if shift == 1:
                moved[:, :, :-1] |= part[:, :, 1:]
            elif shift == -1:
                moved[:, :, 1:] |= part[:, :, :-1]
            enough = moved.sum(axis=1) >= b - a - (b - a >= 3)
            stands |= (enough & moved[:, needed].all(axis=1)).any(axis=1)
    if label in JOINED:
        beside = np.zeros(len(agree), bool)
        for k in range(len(words) - 1):
            if tuple(words[k : k + 2]) == JOINED[label]:
                beside |= (agree[:, k] & agree[:, k + 1]).any(axis=1)
        stands &= beside
    return stands


def _scan(weights: list[float]):
    postings = anchors(weights)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = iter(batch.column(0).to_pylist())
            for part in portions(_texts(batch.column(1))):
                rows = _scan_portion(part, weights, postings)
                columns = [[next(ids) for _ in rows], *map(list, zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    return run


def _scan_portion(texts: list[bytes], weights: list[float], postings: Postings) -> list[tuple]:
    _, starts, _, numbers, bounds = _laid(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    n = len(numbers)
    places: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for words, label in zip(PHRASE_WORDS, PHRASES.values(), strict=True):
        size = len(words)
        if n < size:
            continue
        stands = text[: n - size + 1] == text[size - 1 :]
        for k, word in enumerate(words):
            stands &= numbers[k : n - size + 1 + k] == NUMBER[word]
        for k in np.flatnonzero(stands).tolist():
            places[int(text[k])].append((k - int(bounds[text[k]]), label))
    more = notices(numbers, text, weights, postings)
    rows = []
    for k in range(len(texts)):
        base, own = places.get(k, []), more.get(k, {})
        labels = {label for _, label in base}
        score = max([1.0 if base else 0.0, *own.values()])
        at = [x for x, _ in base]
        every = ",".join(sorted(labels | set(own)))
        rows.append((int(bounds[k + 1] - bounds[k]), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), every, min(score, 1.0)))
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """A row per document; see the module for columns and labels."""
    weights = inverse_frequencies(docs)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(weights), schema)
