"""Toxicity: a learned lexicon, matched with misspellings, weighed by context.

The lexicon is learned from labelled texts: words, and stems that words begin with, that
toxic texts have far more often than others of their language, and surely so. It is a trie; a word is run through the trie
together with the Levenshtein automaton of one edit, so that misspelled terms are found
without listing their misspellings. A hit counts by its kind and by the window of words
around it: whether it stands in quotation marks or is reported, and whether other hits are
near. A logistic regression turns these counts into a score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import sent_if_small, stored

#: A term must occur in so many toxic texts, whatever their number.
LEAST_TEXTS = 5
#: How many times more often toxic texts must have a term.
LEAST_LIFT = 12.0
#: Lengths of stems.
STEMS = range(4, 9)
#: Terms of fewer letters may differ in one place only, which is not the first; terms of
#: three letters only by a digit or sign there, shorter ones must be spelled right.
FUZZY_LETTERS = 5
#: Words on either side of a hit that are its context.
WINDOW = 6
#: Terms worth counting in other texts are sent to every task up to this many bytes; beyond,
#: all terms are counted and joined.
TERMS_SENT = 16 << 20
#: Words a task remembers before it starts anew.
REMEMBERED = 500_000

#: Signs and words of quotation in the languages of the texts.
QUOTES = "\"'`´“”„«»‹›‘’"
REPORTING = frozenset(
    "said says quote quoted quotes wrote called word words term sagte zitat wort schrieb "
    "dit cite citation mot dijo cita palabra".split()
)

FEATURES = ("exact", "stems", "fuzzy", "quoted", "reported", "near", "density", "kinds")
WORD = re.compile(r"[^\W\d_]+")
#: A digit or sign inside a word, or a digit at an end of one.
SIGN = re.compile(
    r"[!-@\[-`{-\u00bf\u00d7\u00f7\u0660-\u0669\u2010-\u2bff\ufe0f\uff01-\uff20\U0001f300-\U0001faff]"
    r"(?:(?<=[^\W\d_].)(?=[^\W\d_])|(?<=[^\W\d_]\d)(?![^\W_])|(?<=\d)(?<![^\W_]\d)(?=[^\W\d_]))"
)


# --- lexicon -----------------------------------------------------------------------


def terms_of(text: str) -> set[str]:
    """Words of a text, and stems, written with ``*`` at the end."""
    words = set(WORD.findall(text.lower()))
    stems = {word[:size] + "*" for word in words for size in STEMS if len(word) > size}
    return words | stems


def count_terms(texts: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """``lang, term, n``: in how many texts of a language each term, or each wanted one, is.

    ``texts`` has ``text, lang``; no language is a language of its own.
    """
    sent = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = sent.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                counts: Counter[tuple[str, str]] = Counter()
                part = batch.slice(begin, 500)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    terms = terms_of(text or "")
                    own = terms if only is None else terms & only
                    counts.update((lang, term) for term in own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang for lang, _ in counts], pa.string()),
                        pa.array([term for _, term in counts], pa.string()),
                        pa.array(list(counts.values()), pa.int64()),
                    ],
                    ["lang", "term", "n"],
                )

    known = texts.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = known.mapInArrow(run, "lang string, term string, n bigint")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def choose_terms(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """``term, n``: terms whose toxic texts are too many for chance.

    ``counts`` has ``lang, term, toxic, clean``, numbers of texts with the term; ``sizes``
    has ``lang, n_toxic, n_clean``. Texts are compared within languages only: were a term no
    sign of toxicity, each text with it would be toxic with its language's share. The lift
    is that of Mantel and Haenszel, the chance is bounded as by Hoeffding, and less than one
    term is expected to be chosen by chance, however many there are.
    """
    both = F.col("n_toxic") + F.col("n_clean")
    total = sizes.agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).first()
    share = (total["t"] or 0) / max((total["t"] or 0) + (total["c"] or 0), 1)
    rows = (
        counts.join(F.broadcast(sizes), "lang")
        .groupBy("term")
        .agg(
            F.sum("toxic").alias("n"),
            F.sum("clean").alias("c"),
            F.sum((F.col("toxic") + F.col("clean")) * F.col("n_toxic") / both).alias("expected"),
            F.sum(F.col("toxic") * F.col("n_clean") / both).alias("more"),
            F.sum(F.col("clean") * F.col("n_toxic") / both).alias("less"),
        )
    )
    n_tested = rows.count()
    n, c, expected = F.col("n"), F.col("c"), F.col("expected")
    rest = F.greatest(n + c - expected, F.lit(1e-9))
    evidence = n * F.log(n / expected) + F.when(c > 0, c * F.log(c / rest)).otherwise(0.0)
    return rows.where(
        (n > expected)
        & (evidence >= math.log(max(n_tested, 1)))
        & (F.col("more") + 0.5 * (1 - share) >= LEAST_LIFT * (F.col("less") + 0.5 * share))
    ).select("term", "n")


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Terms that toxic texts have far more often; ``labelled`` has ``text, toxic, lang``.

    Terms are counted and compared as tables; the driver gets those that are chosen, and
    those worth counting in other texts where these are few bytes.
    """
    columns = [F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "toxic"]
    sizes = stored(
        labelled.select(*columns)
        .groupBy("lang")
        .agg(
            F.count_if(F.col("toxic") == 1).alias("n_toxic"),
            F.count_if(F.col("toxic") == 0).alias("n_clean"),
        ),
        "sizes",
    )
    if not sizes.agg(F.sum("n_toxic")).first()[0]:
        return []
    counted = count_terms(labelled.where("toxic = 1").select("text", "lang"))
    known = counted.select("term", "lang", F.col("n").alias("toxic")).withColumn(
        "in_all", F.sum("toxic").over(Window.partitionBy("term"))
    )
    known = stored(known.where(F.col("in_all") >= LEAST_TEXTS).drop("in_all"), "terms")
    names = known.select("term").distinct()
    size = names.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    wanted = frozenset(row["term"] for row in names.collect()) if size <= TERMS_SENT else None
    clean = count_terms(labelled.where("toxic = 0").select("text", "lang"), wanted)
    if wanted is None:
        clean = clean.join(names, "term", "left_semi")
    counts = known.select("lang", "term", "toxic", F.lit(0).cast("long").alias("clean")).unionByName(
        clean.select("lang", "term", F.lit(0).cast("long").alias("toxic"), F.col("n").alias("clean"))
    )
    counts = stored(counts, "term_counts")
    frequent = {row["term"]: row["n"] for row in choose_terms(counts, sizes).collect()}
    chosen = set(frequent)

    # A stem of many words stands for them; a stem of one word adds nothing to it.
    words = {term for term in chosen if not term.endswith("*")}
    by_stem: dict[str, int] = {}
    for word in words:
        for size in STEMS:
            stem = word[:size] + "*"
            by_stem[stem] = max(by_stem.get(stem, 0), frequent[word])
    stems = {s for s in chosen - words if frequent[s] >= 2 * by_stem.get(s, 0)}

    def begins(term: str) -> bool:
        own = term.rstrip("*")
        return any(own[:size] + "*" in stems for size in STEMS if size < len(own))

    return sorted(term for term in words | stems if not begins(term))


class Trie:
    """Terms as nested dictionaries, run together with Levenshtein automata.

    Where one edit parts a word from a term, one half of the term is whole at its end of the
    word. The terms that are spelled out as a second trie, from their last letter, let the
    automaton start below the half that is whole, whichever it is.
    """

    END, STEM = "\0", "*"

    def __init__(self, terms: list[str]) -> None:
        self._forward: dict = {}
        self._backward: dict = {}
        #: Per direction and half: the node below it, and the lengths of words near its terms.
        self._halves: dict[tuple[bool, str], tuple[dict, set[int]]] = {}
        self.longest = max(map(len, terms), default=0)
        #: Short terms by what is before and after one of their letters.
        self._short: dict[tuple[str, str], str] = {}
        self._stems = {term[:-1] for term in terms if term.endswith(self.STEM)}
        self._stem_sizes = sorted({len(stem) for stem in self._stems})
        for term in terms:
            if term.endswith(self.STEM):
                continue
            if 3 <= len(term) < FUZZY_LETTERS:
                for place in range(1, len(term)):
                    self._short.setdefault((term[:place], term[place + 1 :]), term)
            half = len(term) // 2
            self._add(term, term, True, half)
            if len(term) >= FUZZY_LETTERS:
                self._add(term, term[::-1], False, len(term) - half)
        #: For a word's length, the halves that may be whole in it.
        self._sizes: dict[int, list[tuple[bool, int]]] = {}
        for (front, half), (_, lengths) in sorted(self._halves.items(), key=lambda item: item[0]):
            for length in lengths:
                sizes = self._sizes.setdefault(length, [])
                if (front, len(half)) not in sizes:
                    sizes.append((front, len(half)))

    def _add(self, term: str, letters: str, front: bool, half: int) -> None:
        node = self._forward if front else self._backward
        for place, letter in enumerate(letters, 1):
            node = node.setdefault(letter, {})
            if place == half and len(term) >= FUZZY_LETTERS:
                _, near = self._halves.setdefault((front, letters[:half]), (node, set()))
                near.update(range(len(term) - 1, len(term) + 2))
        node[self.END] = term

    def find(self, word: str) -> tuple[str, int] | None:
        """The term a word is, and how: 0 exact, 1 by its stem, 2 with one edit."""
        node = self._forward
        for letter in word:
            node = node.get(letter)
            if node is None:
                break
        if node is not None and self.END in node:
            return node[self.END], 0
        for size in self._stem_sizes:
            if len(word) > size and word[:size] in self._stems:
                return word[:size], 1
        if 3 <= len(word) < FUZZY_LETTERS:
            for place in range(1, len(word)):
                if len(word) > 3 or not word[place].isalpha():
                    term = self._short.get((word[:place], word[place + 1 :]))
                    if term:
                        return term, 2
        for front, size in self._sizes.get(len(word), ()):
            letters = word if front else word[::-1]
            node, near = self._halves.get((front, letters[:size]), (None, ()))
            if len(word) in near:
                term = self._one_edit(letters, node, size)
                if term:
                    return term, 2
        return None

    def _one_edit(self, word: str, node: dict, place: int) -> str | None:
        """Walks the trie with the automaton's states: places in the word and edits left."""
        stack = [(node, ((place, 1),))]
        size = len(word)
        while stack:
            node, states = stack.pop()
            term = node.get(self.END)
            if term and len(term) >= FUZZY_LETTERS:
                if any(place == size or (left and place + 1 == size) for place, left in states):
                    return term
            for letter, below in node.items():
                if letter == self.END:
                    continue
                following = set()
                for place, left in states:
                    if place < size and word[place] == letter:
                        following.add((place + 1, left))
                    elif left:
                        following.add((place, 0))  # the word lacks the letter
                        if place < size:
                            following.add((place + 1, 0))  # another letter
                            if place + 1 < size and word[place + 1] == letter:
                                following.add((place + 2, 0))  # one letter too many
                if following:
                    stack.append((below, tuple(following)))
        return None


class Scanner:
    """Counts of a text's hits by kind and context."""

    def __init__(self, terms: list[str]) -> None:
        self._trie = Trie(terms)
        self._known: dict[str, tuple[str, int] | None] = {}

    def _mixed(self, text: str, taken: set[int]) -> list[tuple[int, str, int]]:
        """Hits of words with a digit or sign inside, none of whose parts is a hit itself;
        each stands at the place of its first part."""
        found: list[tuple[int, int, str]] = []
        longest = self._trie.longest + 1
        for match in SIGN.finditer(text):
            begin, end = match.span()
            first, last = max(0, begin - longest), min(len(text), end + longest)
            while begin > first and text[begin - 1].isalpha():
                begin -= 1
            while end < last and text[end].isalpha():
                end += 1
            # With more digits, or longer than any term, it is beyond one edit.
            if end - begin > longest or text[begin - 1 : begin].isalnum() or text[end : end + 1].isalnum():
                continue
            word = text[begin:end]
            if word not in self._known:
                self._known[word] = self._trie.find(word.lower())
            own = self._known[word]
            if own and own[1] == 2:
                found.append((begin, end, own[0]))
        if not found:
            return []
        begins = [match.start() for match in WORD.finditer(text)]
        hits = []
        for begin, end, term in found:
            parts = range(bisect_left(begins, begin), bisect_left(begins, end))
            if parts and not taken.intersection(parts):
                hits.append((parts[0], term, 2))
                taken.update(parts)
        return hits

    def features(self, text: str) -> list[float]:
        words = WORD.findall(text)
        hits, known = [], self._known
        if len(known) > REMEMBERED:
            known.clear()
        for place, word in enumerate(words):
            if word not in known:
                known[word] = self._trie.find(word.lower())
            if known[word]:
                hits.append((place, *known[word]))
        hits += self._mixed(text, {place for place, _, _ in hits})
        if not hits:
            return [0.0] * len(FEATURES)
        hits.sort()
        kinds = Counter(kind for _, _, kind in hits)
        quoted = reported = near = 0
        spans = [match.span() for match in WORD.finditer(text)]
        places = np.array([place for place, _, _ in hits])
        for place, _, _ in hits:
            first, last = max(0, place - WINDOW), min(len(words) - 1, place + WINDOW)
            before = text[spans[first][0] : spans[place][0]]
            after = text[spans[place][1] : spans[last][1] + 1]
            quoted += any(sign in before for sign in QUOTES) and any(sign in after for sign in QUOTES)
            reported += any(word.lower() in REPORTING for word in words[first:place])
            near += int(((places >= first) & (places <= last)).sum()) > 1
        return [
            math.log1p(kinds[0]),
            math.log1p(kinds[1]),
            math.log1p(kinds[2]),
            quoted / len(hits),
            reported / len(hits),
            math.log1p(near),
            math.log1p(100 * len(hits) / len(words)),
            math.log1p(len({term for _, term, _ in hits})),
        ]


# --- operator ------------------------------------------------------------------------


def held_out(id: str) -> Column:
    """Rows that no model may learn from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(documents: DataFrame, terms: list[str], id: str, text: str) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                rows = [scanner.features(own or "") for own in part.column(1).to_pylist()]
                columns = np.array(rows, float).reshape(-1, len(FEATURES)).T
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(column) for column in columns)], ["id", *FEATURES]
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{name} double" for name in FEATURES)
    )


def _weights(rows: DataFrame) -> tuple[float, list[float]]:
    """Intercept and weights of a logistic regression; ``rows`` has features and ``toxic``."""
    counts = {row["toxic"]: row["count"] for row in rows.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):  # one class only: its share
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return math.log(share / (1 - share)), [0.0] * len(FEATURES)
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="point").transform(rows)
    model = LogisticRegression(
        featuresCol="point", labelCol="toxic", regParam=1e-3, maxIter=60
    ).fit(points.select("point", F.col("toxic").cast("double").alias("toxic")))
    return float(model.intercept), [float(weight) for weight in model.coefficients]


def score(
    documents: DataFrame,
    labels: DataFrame,
    threshold: float = 0.7,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Toxicity of every text: ``id, held_out, score, predicted`` and the feature columns.

    ``labels`` has ``doc_id, toxic``; only rows that are not held out are learned from, and
    an id with both labels counts as toxic. Terms are learned within the languages of the
    column ``lang``, or in all texts together where there is no such column. Null and empty texts have no hits and score like
    any text without hits. Repeated rows get equal results; texts are read whole; other
    columns are not read; without labels every score is a half; an empty table gives no rows.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy(F.col("doc_id").alias("labelled_id"))
        .agg(F.max("toxic").alias("toxic"))
    )
    known = sent_if_small(known)
    language = F.col(lang) if lang in documents.columns else F.lit("")
    labelled = documents.select(
        F.col(id).alias("labelled_id"), F.col(text).alias("text"), language.alias("lang")
    ).join(known, "labelled_id")
    terms = learn_lexicon(labelled.select("text", "toxic", "lang"))
    rows = stored(_features(documents, terms, id, text), "features")
    intercept, weights = _weights(
        rows.join(known, rows["id"] == F.col("labelled_id")).select(*FEATURES, "toxic")
    )
    total = F.lit(intercept)
    for name, weight in zip(FEATURES, weights):
        total = total + F.col(name) * weight
    return rows.select(
        "id",
        held_out("id").alias("held_out"),
        (1 / (1 + F.exp(-total))).alias("score"),
        *FEATURES,
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
