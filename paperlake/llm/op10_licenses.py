"""Licence scans over a positional index of licence words, in DataFrame functions only.

The index has, for each word of the templates, the templates and places where it
stands. Of each file the licence words of the highest IDF are looked up; a
posting and a place in the file give where the template would begin there, and
the postings of several words are intersected by agreeing beginnings. What is
found is verified by the template's mandatory phrases about their places.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import TEMPLATES, Template

NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Words of a file that are looked up for a template, those of the highest IDF; share of them that must agree where it begins.
RARE, AGREE = 8, 0.75
#: Words by which beginnings, and the places of phrases, may differ: a name in the middle of a text moves what follows.
SLACK = 8
#: A key holds a template and a beginning, which is negative where a template's first words are cut off.
SHIFT, ORIGIN = 34, 1 << 20


def words_of(text: Column) -> Column:
    """The words of a whole text, A-Z in lower case; null counts as empty."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lower, NOT_WORDS), "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORDS, text.lower()) if w]


def _texts(words: Sequence[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def vocabulary(templates: Sequence[Template] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in template_words(t.text)})


def licence_words(words: Column, listed: Sequence[str]) -> Column:
    """The distinct ones of ``words`` that are listed."""
    return F.array_distinct(F.filter(words, lambda w: w.isin(*listed)))


def document_frequencies(docs: DataFrame, text: str = "text", templates: Sequence[Template] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many rows each licence word stands, and the rows, over the whole table: one count per word of a fixed list."""
    found = docs.select(F.explode(F.array_append(licence_words(words_of(F.col(text)), vocabulary(templates)), "")).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts, counts.pop("", 0)


class Index:
    """The templates' words by IDF and the postings, as literals."""

    def __init__(self, templates: Sequence[Template], counts: dict[str, int], n: int):
        def idf(word: str) -> float:
            return math.log(1 + (n - counts.get(word, 0) + 0.5) / (counts.get(word, 0) + 0.5))

        self.words = [template_words(t.text) for t in templates]
        #: Words that stand once in a template, by falling IDF; words that tie by the letters.
        self.ranked = [sorted((w for w, c in Counter(ws).items() if c == 1), key=lambda w: (-idf(w), w)) for ws in self.words]
        self.looked_up = [min(RARE, len(r)) for r in self.ranked]
        self.needed = [math.ceil(AGREE * k) for k in self.looked_up]
        #: Without its word of the highest IDF in a mandatory phrase no file holds a template.
        self.heads = sorted({min((w for p in t.phrases for w in p.split()), key=lambda w: (-idf(w), w)) for t in templates})
        self.labels = [t.label for t in templates]
        self.without = [t.without for t in templates]
        self.phrases = [[(p, self.place(ws, p.split())) for p in t.phrases] for t, ws in zip(templates, self.words, strict=True)]

    @staticmethod
    def place(words: list[str], phrase: list[str]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)

    def candidates(self) -> Column:
        """array<struct<needed, words>>: by template."""
        return F.array(*(F.struct(F.lit(k).alias("needed"), _texts(r).alias("words")) for k, r in zip(self.needed, self.ranked, strict=True)))

    def postings(self) -> Column:
        """array<struct<word, places: array<long>>>: a place is a template's number, shifted, less the position in it."""
        places: dict[str, list[int]] = {}
        for t, (ws, ranked) in enumerate(zip(self.words, self.ranked, strict=True)):
            for w in ranked:
                places.setdefault(w, []).append((t << SHIFT) - ws.index(w) + ORIGIN)
        return F.array(*(F.struct(F.lit(w).alias("word"), F.array(*(F.lit(p).cast("long") for p in x)).alias("places")) for w, x in sorted(places.items())))

    def facts(self) -> Column:
        """array<struct<label, looked_up, needed, size, phrases, without>>: by template."""
        out = []
        for t, label in enumerate(self.labels):
            phrases = F.array(*(F.struct(F.lit(f" {p} ").alias("text"), F.lit(at).alias("at"), F.lit(len(p.split())).alias("n")) for p, at in self.phrases[t]))
            without = _texts([f" {p} " for p in self.without[t]])
            out.append(F.struct(F.lit(label).alias("label"), F.lit(self.looked_up[t]).alias("looked_up"), F.lit(self.needed[t]).alias("needed"), F.lit(len(self.words[t])).alias("size"), phrases.alias("phrases"), without.alias("without")))
        return F.array(*out)

    def rare(self, own: Column, none: Column) -> Column:
        """The words to look up of a file with the licence words ``own``: for each template those of the highest IDF that the file holds."""
        held = F.transform(self.candidates(), lambda t: F.struct(t["needed"].alias("needed"), F.array_intersect(t["words"], own).alias("has")))
        chosen = F.transform(held, lambda t: F.when(F.size(t["has"]) >= t["needed"], F.slice(t["has"], 1, RARE)).otherwise(none))
        return F.when(F.arrays_overlap(own, _texts(self.heads)), F.array_distinct(F.flatten(chosen))).otherwise(none)

    def found(self, words: Column, rare: Column, at: Column) -> Column:
        """array<struct<label, share>> of the templates that match, from the places ``at`` of the words looked up."""
        lists = F.filter(self.postings(), lambda y: F.array_contains(rare, y["word"]))
        nothing = F.array().cast("array<struct<label:string,share:double>>")

        def begun(lists: Column) -> Column:
            """For each place of a looked-up word and each of its postings: the template, and where it would begin."""
            places = lambda x: F.coalesce(F.get(F.filter(lists, lambda y: y["word"] == x["w"]), F.lit(0))["places"], F.array().cast("array<bigint>"))
            return F.sort_array(F.flatten(F.transform(at, lambda x: F.transform(places(x), lambda p: p + x["i"]))))

        def agreed(keys: Column) -> Column:
            """The beginnings on which enough places agree; keys are sorted, so the next ones are the nearest."""
            votes = lambda k, i: sum(F.coalesce((F.get(keys, i + j) - k <= SLACK).cast("int"), F.lit(0)) for j in range(RARE))
            counted = F.transform(keys, lambda k, i: F.struct(F.shiftright(k, SHIFT).cast("int").alias("t"), (k.bitwiseAND(F.lit((1 << SHIFT) - 1)) - ORIGIN).alias("at"), votes(k, i).alias("votes")))
            return F.filter(counted, lambda x: x["votes"] >= F.get(F.array(*map(F.lit, self.needed)), x["t"]))

        def verified(x: Column) -> Column:
            stand = F.forall(x["t"]["phrases"], lambda p: F.contains(_joined(words, x["at"] + p["at"] - SLACK, x["at"] + p["at"] + p["n"] + 2 * SLACK), p["text"]))
            return stand & ~F.exists(x["t"]["without"], lambda p: F.contains(_joined(words, x["at"], x["at"] + x["t"]["size"] + 8 * SLACK), p))

        def named(some: Column) -> Column:
            facts = F.transform(some, lambda x: F.struct(F.get(self.facts(), x["t"]).alias("t"), x["at"].alias("at"), x["votes"].alias("votes")))
            return F.transform(F.filter(facts, verified), lambda x: F.struct(x["t"]["label"].alias("label"), F.least(x["votes"] / x["t"]["looked_up"], F.lit(1.0)).alias("share")))

        every = _let(lists, lambda x: _let(begun(x), lambda keys: named(agreed(keys))))
        return F.when(F.size(rare) > 0, every).otherwise(nothing)


def _joined(words: Column, begin: Column, end: Column) -> Column:
    """Words from ``begin`` up to ``end``, with a blank before and after each."""
    at = F.greatest(begin, F.lit(0))
    return F.concat(F.lit(" "), F.array_join(F.slice(words, (at + 1).cast("int"), F.greatest(end - at, F.lit(0)).cast("int")), " "), F.lit(" "))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Looked up are, for each template, the ``RARE`` words of the highest IDF
    among those of its words that the file holds; all of a file's words so
    chosen are looked up for all templates, so that no licence crowds out
    another. A template matches where ``AGREE`` of as many places agree on its
    beginning, ``SLACK`` words more or less, its mandatory phrases stand about
    their places, and none of those that rule it out stands in its length. Its
    label joins those of the base phrases. score is 1 with a base phrase, else
    the best share of agreeing places of a matching template, 0 without labels.
    Null and empty texts have no words, no labels and null places; null keys and
    repeated rows are returned as they are; an empty table gives no rows.
    """
    index = Index(templates, *document_frequencies(docs, text, templates))
    found = _let(words_of(F.col(text)), lambda words: _scanned(words, index, vocabulary(templates)))
    return docs.select(F.col(key).alias("doc_id"), found.alias("_found")).select("doc_id", "_found.*")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often it is named, also where a filter is pushed below the scan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scanned(words: Column, index: Index, listed: list[str]) -> Column:
    """The struct of a file's results from its words."""
    begins = sorted({p.split()[0] for p, _ in BASE})
    none = F.array().cast("array<string>")

    def result(base: Column, found: Column) -> Column:
        starts = F.transform(base, lambda y: y["i"].cast("long"))
        names = F.transform(base, lambda y: y["label"])
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(names, F.transform(found, lambda y: y["label"]))), ",").alias("labels"),
            F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform(found, lambda y: y["share"])), F.lit(0.0))).alias("score"),
        )

    def placed(own: Column, rare: Column) -> Column:
        wanted = F.arrays_overlap(own, _texts(begins)) | (F.size(rare) > 0)
        at = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(*begins) | F.array_contains(rare, x["w"]))
        return F.when(wanted, at).otherwise(F.array().cast("array<struct<w:string,i:int>>"))

    def of_words(own: Column) -> Column:
        return _let(index.rare(own, none), lambda rare: _let(placed(own, rare), lambda at: of_places(rare, at)))

    def of_places(rare: Column, at: Column) -> Column:
        return _let(_base(words, at), lambda base: _let(index.found(words, rare, at), lambda found: result(base, found)))

    return _let(licence_words(words, [*listed, *begins]), of_words)


def _base(words: Column, at: Column) -> Column:
    """The places of the base phrases, with their labels."""

    def label_at(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for phrase, label in BASE:
            stands = F.lit(True)
            for k, w in enumerate(phrase.split()):
                stands = stands & F.coalesce(F.get(words, x["i"] + k) == w, F.lit(False))
            out = F.when((x["w"] == phrase.split()[0]) & stands, label).otherwise(out)
        return out

    return F.filter(F.transform(at, lambda x: F.struct(label_at(x).alias("label"), x["i"].alias("i"))), lambda y: y["label"].isNotNull())


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
