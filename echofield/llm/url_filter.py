"""URL filter: rules first, then segmented names scored by naive Bayes.

* Rules name a host and a path prefix; they fit the host and its subdomains. The
  longest rule that fits decides.
* Names (runs of letters in host and path) are often words without spaces between.
  Each distinct name is split into words by the Viterbi algorithm over a unigram model,
  which counts the words of all pages' texts. Only words that stand in a name can matter
  to it, so each name gets just these, by a join.
* Multinomial naive Bayes scores the words. It learns from all urls that a rule judges,
  or from labelled urls that are given; their names are split in the same way. Its
  counts are made by grouping, and its log odds meet the words by a join, so neither
  urls nor vocabulary pass through the driver.

Scores add up over words, so each distinct set of names is scored once, and urls get the
score of theirs. Names and words that very many hold are dealt over several tasks.

Defined results: a null url, or one without ://, has an empty host and path; no rule
fits it, and without names its score is the prior's. Words that no example has count
for nothing; without examples the score is 0.5 and the verdict is allow. Markup that is
left open runs to the next tag; a script left open, to the end. Repeated rows get equal
results. Empty tables give an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Rules in the order in which they were given.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

LONGEST_WORD = 20
SMOOTHING = 0.5
BLOCK_ABOVE = 0.5

TAG = re.compile(r"<(/?)(?:(script|style)\b)?[^<>]*>", re.I)


# Parts of a url


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


# Segmentation


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split of a name into words.

    A piece that isn't a word has the probability of ten unlikely letters each.
    """
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(name[start:end], 0)
            cost = math.log(total) - math.log(n) if n else math.log(total) + (end - start) * math.log(10)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def visible(html: str) -> str:
    """The text outside of tags, scripts and styles, in one pass."""
    out, at, inside = [], 0, None
    for tag in TAG.finditer(html):
        name = (tag[2] or "").lower()
        if inside:
            if tag[1] and name == inside:
                inside, at = None, tag.end()
            continue
        out.append(html[at : tag.start()])
        at = tag.end()
        if name and not tag[1]:
            inside = name
    if not inside:
        out.append(html[at:])
    return " ".join(out)


def page_words(html: str) -> list[str]:
    """The words of a page's text that the unigram model counts."""
    text = visible(html).lower().replace(".", " ").replace(",", " ")
    return [w for w in text.split() if w.isascii() and w.isalpha() and len(w) <= LONGEST_WORD]


def _page_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[str] = Counter()
        for html in batch.column(0):
            counts.update(page_words(html.as_py() or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n: words of all pages' texts."""
    return pages.select(F.col("html").cast("string")).mapInArrow(_page_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segments(names: DataFrame, words: DataFrame) -> DataFrame:
    """(name, words) for each distinct name."""
    total = words.agg(F.sum("n")).first()[0] or 1
    lengths = F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("name")))
    starts = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"), lengths.alias("lengths"))
    pieces = starts.select("name", F.explode(F.transform("lengths", lambda k: F.substring(F.col("name"), F.col("start"), k))).alias("word")).distinct()
    pieces = written(pieces, "url-pieces")
    # A name's words are no more than its substrings. Many names hold one letter.
    holders = pieces.groupBy("word").agg(F.count(F.lit(1)).alias("names"))
    held = written(words.join(holders, "word"), "url-piece-counts")
    own = salted_join(pieces, held, ["word"], "names", F.xxhash64("name")).groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("counts"))

    @F.pandas_udf("array<string>")
    def split(name: pd.Series, counts: pd.Series) -> pd.Series:
        rows = [dict((x["word"], int(x["n"])) for x in (c if c is not None else [])) for c in counts]
        return pd.Series([viterbi(n, c, total) for n, c in zip(name, rows, strict=True)])

    return names.join(own, "name", "left").select("name", split("name", "counts").alias("words"))


# Naive Bayes


def names_of(host: Column, path: Column) -> Column:
    """The names of a url in order of the alphabet, as one string."""
    return F.concat_ws(" ", F.array_sort(F.regexp_extract_all(lower_ascii(F.concat_ws("/", host, path)), F.lit("([a-z]+)"), 1)))


def log_odds(counts: DataFrame) -> DataFrame:
    """word, odds of block against allow, from word, block, allow: how often each has it."""
    totals = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("kinds")).first()  # three numbers
    share = lambda label: F.log((F.col(label) + SMOOTHING) / ((totals[label] or 0) + SMOOTHING * totals["kinds"]))
    return counts.select("word", (share("block") - share("allow")).alias("odds"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score, words; a row per page.

    labelled: urls with a verdict of block or allow to learn from, instead of those that
    the rules judge.
    """
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("names", names_of(F.col("host"), F.col("path")))
    examples = rows.select("names", F.col("ruled").alias("label"))
    if labelled is not None:
        host, path = parts(F.col("url"))
        examples = labelled.select(names_of(host, path).alias("names"), F.col("verdict").alias("label"))
    seen = rows.select("names", F.lit(1).alias("n"), F.lit(None).cast("string").alias("label")).unionByName(examples.select("names", F.lit(0).alias("n"), "label"))
    counted = lambda label: F.sum((F.col("label") == label).cast("long"))
    kinds = seen.groupBy("names").agg(F.sum("n").alias("n"), F.coalesce(counted("block"), F.lit(0)).alias("block"), F.coalesce(counted("allow"), F.lit(0)).alias("allow"))
    kinds = written(kinds, "url-names")
    each = written(kinds.select("names", "block", "allow", F.explode(F.split("names", " ")).alias("name")).where("name <> ''"), "url-each-name")
    held = each.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    split = segments(held.select("name"), written(unigrams(pages), "url-unigrams"))
    split = written(held.join(split, "name"), "url-segments")
    words = split.select("name", "block", "allow", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("names"), F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    odds = written(counts.join(log_odds(counts.where("block + allow > 0")), "word").select("word", "names", "odds"), "url-odds")
    values = salted_join(words.select("name", "word"), odds, ["word"], "names", F.xxhash64("name")).groupBy("name").agg(F.sum("odds").alias("value"))
    valued = written(split.join(values, "name", "left").select("name", "kinds", F.array_join("words", " ").alias("words"), F.coalesce("value", F.lit(0.0)).alias("value")), "url-values")
    scored = salted_join(each.select("names", "name"), valued, ["name"], "kinds", F.xxhash64("names"))
    scored = scored.groupBy("names").agg(F.sum("value").alias("value"), F.array_join(F.array_sort(F.collect_list("words")), " ").alias("words"))
    labels = kinds.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("block"), F.coalesce(F.sum("allow"), F.lit(0)).alias("allow")).first()
    prior = math.log((labels["block"] + SMOOTHING) / (labels["allow"] + SMOOTHING))
    score = 1 / (1 + F.exp(-(F.coalesce("value", F.lit(0.0)) + prior)))
    facts = kinds.where("n > 0").join(scored, "names", "left").select("names", "n", F.coalesce("words", F.lit("")).alias("words"), F.round(score, 12).alias("score"))
    out = salted_join(rows, written(facts, "url-scores"), ["names"], "n", F.xxhash64("page_id"))
    method = F.when(F.col("score") > BLOCK_ABOVE, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "score", "words")
