from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from echofield.llm import license_scan, packing, quality, spotsigs

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_spotsigs_next_and_edited(odd, odd_rows):
    rows = sorted(((-(1 << 63) if x[0] is None else x[0], x[1] or "") for x in odd_rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = spotsigs.signatures(text)
        near = spotsigs.likeness(own, spotsigs.signatures(edited))
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(near, 9), round(spotsigs.likeness(own, spotsigs.signatures(after)), 9)))
    got = [(-(1 << 63) if x.doc_id is None else x.doc_id, x.n_chars, x.edited_sha256, round(x.near_edited, 9), round(x.near_next, 9)) for x in spotsigs.fingerprints(odd).collect()]
    assert sorted(got) == sorted(want)


def test_spotsigs_alone_and_empty(spark, none):
    one = spark.createDataFrame([(5, "the cat and the big dog sat on the mat")], "doc_id long, text string")
    row = spotsigs.fingerprints(one).first()
    assert row.near_next == 1.0
    assert spotsigs.fingerprints(none).count() == 0


def test_spotsigs_pairs(spark):
    text = " ".join(f"the word{k} thing{k} of" for k in range(60))
    other = text.replace("word3 ", "else ")
    docs = spark.createDataFrame([(1, text), (2, other), (3, text), (4, "of nothing like it at all"), (5, None)], "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(docs)
    assert [(x.a, x.b) for x in pairs.collect()] == [(1, 2)]
    assert {(x.doc_id, x.representative) for x in members.collect()} == {(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)}


def plain_signatures(text):
    """Anchors with the next two words that aren't common, as texts."""
    words = re.findall(r"[^\W_]+", text.lower())
    out = set()
    for k, word in enumerate(words):
        common = word in spotsigs.ANCHORS
        if common or zlib.crc32(word.encode()) % 16 == 0:
            chain = [w for w in words[k + 1 :] if w not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                out.add((word, *chain))
    return out or ({tuple(words)} if words else set())


def test_spotsigs_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "PAIRS_PER_TASK", 8)
    rng = np.random.default_rng(12)
    vocabulary = ["the", "of", "and", "in"] * 6 + [f"word{k}" for k in range(90)]
    texts = []
    for _ in range(25):
        base = rng.choice(vocabulary, rng.integers(5, 400)).tolist()
        for _ in range(rng.integers(1, 6)):
            own = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in base]
            texts.append(" ".join(own[: len(own) - rng.integers(0, 12)]))
    texts += [texts[0], "", None, "the of", "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [plain_signatures(t or "") for t in texts]
    assert [len(x) for x in sets] == [len(spotsigs.signatures(t or "")) for t in texts]
    first = {}
    for k, x in enumerate(sets):
        first.setdefault(frozenset(x), k)
    want = {}
    kinds = list(first.items())
    for i, (x, a) in enumerate(kinds):
        for y, b in kinds[:i]:
            if x and y and len(x & y) / len(x | y) >= 0.8:
                want[min(a, b), max(a, b)] = len(x & y) / len(x | y)
    pairs, members = spotsigs.near_pairs(docs)
    assert {(x.a, x.b): x.likeness for x in pairs.collect()} == pytest.approx(want) and len(want) > 15
    assert {x.doc_id: x.representative for x in members.collect()} == {k: first[frozenset(x)] for k, x in enumerate(sets)}


def test_packing_round_trip(odd, odd_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.sequences(odd).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert got.length.map(lambda n: n & (n - 1) == 0 and n <= 2048).all()
    left = got.copy()
    for row in odd_rows:
        ids = np.array([*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want = []
        start = 0
        for n in packing.lengths(len(ids)):
            want.append((start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
            start += n
        own = left[left.doc_id.isna() if row[0] is None else left.doc_id == row[0]].sort_values("start")
        assert set(want) <= set(zip(own.start, own.length, own.ids_crc32, own.doc_tokens, strict=True))
        for piece in own.itertuples():
            assert np.array_equal(np.array(piece.ids), ids[piece.start : piece.start + piece.length].astype(int))


def test_packing_fills_batches_of_one_length(spark):
    docs = spark.createDataFrame([(k, "the cat " * (k % 9)) for k in range(300)], "doc_id long, text string").repartition(2)
    got = packing.pieces(docs).toPandas()
    assert (got.length == 2**got.bucket).all()
    sizes = got.groupby(["bucket", "batch"]).length.sum()
    assert sizes.max() <= 1 << 16 and got.groupby(["bucket", "batch"]).length.nunique().max() == 1


def test_packing_lengths_are_binary():
    assert packing.lengths(1) == [1]
    assert packing.lengths(2048) == [2048]
    assert packing.lengths(5000) == [2048, 2048, 512, 256, 128, 8]


@pytest.mark.parametrize("text", ["a <|endoftext|> b x<|startoftext|>y <|ENDOFTEXT|> <|endof text|>", "<|endoftext|> don't DON'T it's", "naïve café ÉTÉ. a,b..c !? #1 2nd", "ΣΑΣ İstanbul \u00a0x\u2003y e\u0301", "a\x1cb\x85c", "ab" * 40 + ". " + "q" * 30])
def test_tokenizer_agrees_on_odd_words(text):
    from tokenizers import Tokenizer

    encoder = packing.Encoder(packing.default_vocabulary())
    untouched = Tokenizer.from_file(packing.default_vocabulary())
    want = np.array(untouched.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert encoder.encode([text]) == [want]
    assert encoder.encode([text, "", text]) == [want, b"", want]


def test_packing_empty(none):
    assert packing.pieces(none).count() == 0


def labelled(spark, n=400):
    good = "the {0} of the {1} and the {2} in the {0} was {1}"
    bad = "BUY {0}!! NOW!! {1}!! {2}!!"
    rows, labels = [], []
    for k in range(n):
        label = int(k % 4 != 0)
        rows.append((k, (good if label else bad).format(f"w{k % 17}", f"v{k % 13}", f"u{k % 11}") * 3, "src9" if label else "src1"))
        labels.append((k, label, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {x.doc_id: x.quality for x in labels.collect()}
    got = quality.score(docs, labels).collect()
    assert len(got) == 400
    held = [x for x in got if x.held_out]
    assert {x.doc_id for x in held} == {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(x.predicted == truth[x.doc_id] == int(x.score >= 0.3) for x in held)


def test_quality_ignores_held_out_labels_and_other_columns(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    one = {x.doc_id: x.score for x in quality.score(docs, labels).collect()}
    two = {x.doc_id: x.score for x in quality.score(docs.withColumn("source", F.lit("x")), flipped).collect()}
    assert one == two


def test_quality_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(odd, labels).collect()
    assert len(got) == odd.count() and all(x.score == 0.5 for x in got)
    docs, labels = labelled(spark)
    assert quality.score(none, labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns
    scores = quality.fit(list(quality.bags([b"good " * 5, b"bad " * 5])), [1, 0]).scores([b"", b"good " * 9000, b"good " * 9000])
    assert 0 <= scores[0] <= 1 and scores[1] == scores[2]


def test_quality_features_and_scores_against_brute_force():
    texts = ["the cat the  cat sat", "", "\tx", "naïve\nnaïve naïve", "word " * 40]

    def mixed_hash(x):
        return ((x ^ x >> 29) * 0xD6E8FEB86659FD93 & 2**64 - 1) >> 46

    base, whole = 0x9E3779B97F4A7C15, 2**64
    table = np.random.default_rng(2).normal(size=quality.BUCKETS).astype(np.float32)
    for bag, score, text in zip(quality.bags([t.encode() for t in texts]), quality.Model(table, 0.25).scores([t.encode() for t in texts]), texts, strict=True):
        words = text.encode().split()
        hashes = [sum((c + 1) * base**k for k, c in enumerate(w)) % whole for w in words]
        want = []
        framed = b" " + text.encode() + b" "
        for size, salt in ((3, 3), (4, 4)):
            for k in range(len(framed) - size + 1):
                inner = framed[k + 1 : k + size - 1]
                if not set(inner) & set(b" \t\n\r\x0b\x0c"):
                    want.append(mixed_hash((int.from_bytes(framed[k : k + size], "little") * base + salt) % whole))
        want += [mixed_hash(h) for h in hashes]
        want += [mixed_hash(((b - a) * base + 2) % whole) for a, b in zip(hashes, hashes[1:], strict=False)]
        got = dict(zip(bag.buckets().tolist(), bag.shares().tolist(), strict=True))
        assert {b: round(s * len(want)) for b, s in got.items()} == Counter(want)
        value = sum(table[b] * s for b, s in got.items()) + 0.25
        assert abs(score - 1 / (1 + np.exp(-value))) < 1e-4


def test_quality_tells_words_apart_that_share_letters():
    examples = list(quality.bags([b"good words here", b"bad things there", b"good good", b"bad bad"] * 20))
    model = quality.fit(examples, [1, 0, 1, 0] * 20)
    assert (model.scores([b"good words here", b"bad things there"]) >= 0.5).tolist() == [True, False]


def test_quality_learns_from_long_texts_too(spark):
    long_ = [(k, ("fine prose of the day " if k % 2 else "CLICK NOW $$$ ") * 3000) for k in range(60)]
    docs = spark.createDataFrame(long_, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    assert all(x.predicted == x.doc_id % 2 for x in quality.score(docs, labels).collect())


def brute_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def test_licences_against_brute_force(odd, odd_rows, spark):
    extra = [(100, "the MIT\tLicense; mit license"), (101, "Licensed under CC-BY-NC 4.0. cc by"), (102, "GNU General Public Licence"), (103, "xmit license mit licensé"), (104, "This work is licensed under the GNU General Public License, version 3."), (105, None)]
    rows = [(x[0], x[1]) for x in odd_rows] + extra
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = []
    for i, text in rows:
        words, at, labels = brute_words(text), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            for k in range(len(words) - len(p) + 1):
                if words[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((i, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    got = {}
    result = license_scan.scan(docs).collect()
    assert sorted([(x.doc_id, x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) for x in result], key=str) == sorted(want, key=str)
    got = {x.doc_id: x for x in result}
    assert got[104].labels == "gpl,gpl-3.0" and got[101].labels == "cc-by,cc-by-nc"
    assert all(0 <= x.score <= 1 and set(x.base_labels.split(",")) - {""} <= set(x.labels.split(",")) for x in result)


def test_licences_of_a_file_with_many_notices(spark):
    texts = {label: passages[0] for label, passages in license_scan.NOTICES.items()}
    filler = " some other words between them and the next of the terms "
    common = [(k, texts["gpl-3.0"] + filler + texts["apache-2.0"]) for k in range(1, 40)]
    many = [(100, filler.join(texts.values())), (101, filler.join(texts[x] for x in ("mpl-2.0", "epl", "boost", "cc0", "gpl-3.0", "apache-2.0")))]
    every = [(200 + k, "Copyright 2020. " + p + filler) for k, p in enumerate(p for x in license_scan.NOTICES.values() for p in x)]
    docs = spark.createDataFrame(common + many + every, "doc_id long, text string")
    got = {x.doc_id: set(x.labels.split(",")) for x in license_scan.scan(docs).collect()}
    assert got[100] >= set(texts)
    assert got[101] >= {"mpl-2.0", "epl", "boost", "cc0", "gpl-3.0", "apache-2.0"}
    for k, (label, _) in enumerate(license_scan.PASSAGES):
        assert label in got[200 + k]


def test_each_passage_has_a_key_phrase():
    assert all(license_scan.KEYS) and set(license_scan.NOTICES) == set(license_scan.KEY_PHRASES)


def test_licences_candidates_are_complete():
    rng = np.random.default_rng(5)
    for _ in range(40):
        weights = (1 + 6 * rng.random(len(license_scan.VOCABULARY))).tolist()
        postings, words, of = license_scan.anchors(weights), [], []
        for text in range(2):
            for passage in rng.permutation(len(license_scan.PASSAGES))[:4]:
                own = license_scan.PASSAGES[passage][1][int(rng.integers(0, 2)) :]
                own = [w if rng.random() > 0.08 else None for w in own] + [None, "the", "of"]
                words += own
                of += [text] * len(own)
        numbers = np.array([license_scan.NUMBER.get(w, -1) for w in words])
        rigid, loose = ({0: {}, 1: {}} for _ in range(2))
        for (label, template), keys in zip(license_scan.PASSAGES, license_scan.KEYS, strict=True):
            each = [license_scan.NUMBER[w] for w in template]
            whole = sum(weights[n] for n in each)
            for text in range(2):
                at = {k: n for k, (n, t) in enumerate(zip(numbers.tolist(), of, strict=True)) if t == text}
                for offset in range(min(at) - len(each), max(at) + 1):
                    same = [at.get(offset + k) == n for k, n in enumerate(each)]
                    share = sum(weights[n] for n, x in zip(each, same, strict=True) if x) / whole
                    pair = license_scan.JOINED.get(label)
                    joined = pair is None or any(tuple(template[k : k + 2]) == pair and all(same[k : k + 2]) for k in range(len(template)))
                    if joined and share >= license_scan.LEAST_SHARE and any(all(same[a:b]) for a, b in keys):
                        rigid[text][label] = max(share, rigid[text].get(label, 0.0))
                loose[text][label] = max(weighed(each, list(at.values()), weights) / whole, loose[text].get(label, 0.0))
        got = license_scan.notices(numbers, np.array(of), weights, postings)
        for text in range(2):
            found = got.get(text, {})
            # What stands word for word is found, and nothing beyond what agrees in order.
            assert all(found.get(label, 0.0) >= share - 1e-9 for label, share in rigid[text].items())
            assert all(share <= loose[text][label] + 1e-9 for label, share in found.items())
            assert all(share >= license_scan.LEAST_SHARE or min(len(x) for own, x in license_scan.PASSAGES if own == label) < 12 for label, share in found.items())


def weighed(a: list[int], b: list[int], weights: list[float]) -> float:
    """The heaviest common subsequence."""
    best = [0.0] * (len(b) + 1)
    for x in a:
        before, best = best, [0.0] * (len(b) + 1)
        for k, y in enumerate(b):
            best[k + 1] = max(before[k + 1], best[k], before[k] + (weights[x] if x == y else 0.0))
    return best[-1]


def edited(words: list[str], kinds: list[str], rng) -> list[str]:
    out = list(words)
    for kind in kinds:
        k = int(rng.integers(0, len(out)))
        if kind == "insert":
            out.insert(k, "zebra")
        elif kind == "delete":
            del out[k]
        else:
            out[k] = "zebra"
    return out


@pytest.mark.parametrize("kind", ["insert", "delete", "change", "mixed"])
@pytest.mark.parametrize("edits", [1, 2, 3])
def test_licences_are_found_with_words_changed(kind, edits):
    """Recall over the longest passage of each licence; and no licence is taken for another of its kind."""
    rng = np.random.default_rng(edits)
    weights = (1 + 3 * rng.random(len(license_scan.VOCABULARY))).tolist()
    postings, hits, tried, wrong = license_scan.anchors(weights), 0, 0, 0
    of_kind = {"gpl-2.0", "gpl-3.0", "lgpl", "agpl"}
    for label, texts in license_scan.NOTICES.items():
        words = max(texts, key=len).split()
        if edits > 1 and len(words) < 8 * edits:
            continue  # too short for so many changes to leave four fifths
        for _ in range(40):
            kinds = [kind if kind != "mixed" else str(rng.choice(["insert", "delete", "change"])) for _ in range(edits)]
            own = ["some", "words", *edited(words, kinds, rng), "and", "more"]
            # Without a word that tells it apart a text is that of another licence, or of none.
            if not all(w in own for w in license_scan.ESSENTIAL[label]):
                continue
            numbers = np.array([license_scan.NUMBER.get(w, -1) for w in own])
            found = license_scan.notices(numbers, np.zeros(len(own), np.int64), weights, postings).get(0, {})
            hits, tried = hits + (label in found), tried + 1
            wrong += bool(label in of_kind and set(found) & of_kind - {label})
    print(kind, edits, hits / tried)
    assert hits / tried >= 0.9 and wrong == 0, hits / tried


def test_licences_empty(none, spark):
    assert license_scan.scan(none).count() == 0
    plain = spark.createDataFrame([(1, "zebra quagga"), (2, None)], "doc_id long, text string")
    assert [(x.labels, x.score) for x in license_scan.scan(plain).collect()] == [("", 0.0)] * 2


def test_pairs_of_documents_without_ids(spark):
    """Classes whose documents have no doc_id are classes of their own."""
    rng = np.random.default_rng(11)
    words, other = (rng.choice([*["the", "of", "and"] * 10, *(f"{x}{k}" for k in range(90))], 600).tolist() for x in ("word", "thing"))
    near = " ".join([*words[:-3], "one", "more", "change"])
    rows = [(None, " ".join(words)), (None, near), (1, " ".join(other)), (None, " ".join([*other[:-3], "and", "one", "here"]))]
    pairs, members = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((x.a, x.b) for x in pairs.collect()), key=str) == [(1, None), (None, None)]
    assert members.count() == 4


def test_fingerprint_strings_by_another_reading(spark):
    """Both strings hold one signature for each chain that a plain reading finds, whatever the order of words."""
    text = "the quick brown fox is a fast one and the lazy dog is of a slow kind " * 3
    rows = [(2, text), (1, "short other text in the end of it all")]
    found = {x.doc_id: x for x in spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names: dict = {}  # a signature's rendering always stands for the same set of chains
    for k, own, after in ((2, text, rows[1][1]), (1, rows[1][1], text)):
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        sets = frozenset(plain_signatures(own)), frozenset(plain_signatures(edited))
        for chains, shown in zip(sets, (found[k].fingerprint, found[k].edited_fingerprint), strict=True):
            assert names.setdefault(shown, chains) == chains
        assert found[k].near_edited == pytest.approx(len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
        assert found[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert len(set(names.values())) == len(names)
