"""Periodic runs, line dedup and collocations against brute force, and on odd tables."""

import collections
import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logloom.llm import bpe, collocations, line_dedup, packing, queries, runs
from logloom.llm.near_dedup import Likeness, near_duplicates

SF = "/root/testdata/sf0.001"
LINE = "a line that is long enough to count as common, once it is found often"
ODD = [
    (1, LINE + "\nown line one"),
    (1, LINE + "\nown line one"),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (None, f"{LINE}\n\n{LINE.upper()}  \nwithout an id"),
    (None, f"\t{LINE}\x0b"),
    (5, f"{LINE}\r\n{LINE}x"),
    (6, f"first\n{LINE}\n"),
    (7, f"{LINE} \n {LINE}"),
    (8, "x" * 50_000),
    (10, "été 中文 \U0001f600 a.b,c " * 40),
    (11, "tick tock " * 6_000 + "and " + "bang " * 40),
    (12, LINE),
    (13, "\n".join(f"line number {n} of a very long text with many lines" for n in range(3_000))),
]
SCHEMA = (
    "doc_id bigint, text string, lang string, id string, own long, place string, hash int, "
    "phrase string, count string, runs string, gone int, holder string, n string"
)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (number, text, (None, "en", "und")[place % 3], "a", 1, "b", 2, "c", "d", "e", 3, "f", "g")
        for place, (number, text) in enumerate(ODD)
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- periodic runs ------------------------------------------------------------------


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def slow_runs(words):
    """Every stretch of equal neighbours at a distance, if no shorter distance has it."""
    found = set()
    for period in range(1, len(words) // 4 + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            length = end - start + period
            if end > start and length >= max(6, 4 * period):
                part = words[start : start + length]
                if all(part[q:] != part[:-q] for q in range(1, period)):
                    found.add((start, length, period))
            start = max(end, start + 1)
    return sorted(found, key=lambda run: (run[0], run[2]))


def slow_report(number, text):
    words = words_of(text)
    draw = None if number is None else zlib.crc32(str(number).encode())
    if words and draw is not None and draw % 10 == 0:
        g = draw // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    return (
        number,
        len(found),
        *(best or (None,) * 3),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{p}\n" for s, length, p in found)),
        sha(" ".join(word for i, word in enumerate(words) if i not in gone)),
    )


def reported(frame):
    found = runs.report(runs.find_runs(runs.with_planted_runs(frame)))
    return collections.Counter(map(tuple, found.collect()))


def test_runs_of_short_sequences_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for number in range(1_500):
        size, letters = int(rng.integers(0, 70)), int(rng.integers(1, 5))
        symbols = rng.integers(0, letters, size)
        if number % 2 and size > 10:
            period = int(rng.integers(1, 7))
            symbols[size // 4 :] = np.resize(symbols[:period], size - size // 4)
        assert runs.runs_of(symbols) == slow_runs(symbols.tolist())


def test_runs_of_many_texts_at_once_stay_apart():
    rng = np.random.default_rng(6)
    texts = [
        [b"%d" % word for word in rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 90)))]
        for _ in range(400)
    ]
    assert runs.runs_of_texts(texts) == [slow_runs(text) for text in texts]


def test_suffix_tree_tells_how_far_suffixes_agree():
    rng = np.random.default_rng(7)
    for letters in (1, 2, 5):
        symbols = [*rng.integers(0, letters, 60).tolist(), letters]
        tree = runs.SuffixTree(symbols)
        order = sorted(range(len(symbols)), key=lambda place: symbols[place:])
        assert np.argsort(tree.rank).tolist() == order
        pairs = np.array(list(itertools.combinations(range(len(symbols)), 2)))
        expected = [
            next(n for n in itertools.count() if symbols[a + n] != symbols[b + n])
            for a, b in pairs.tolist()
        ]
        assert tree.agreement(pairs[:, 0], pairs[:, 1]).tolist() == expected


def test_runs_of_the_documents_are_those_of_brute_force(documents):
    rows = documents.where(F.length("text") < 6_000).select("doc_id", "text")
    expected = collections.Counter(slow_report(*row) for row in rows.collect())
    assert sum(row[1] > 0 for row in expected) > 5
    assert reported(rows) == expected


def test_runs_of_odd_rows(odd):
    assert reported(odd) == collections.Counter(slow_report(*row) for row in ODD)
    assert runs.find_runs(odd.where("false")).count() == 0


# --- lines ----------------------------------------------------------------------------


def slow_lines(rows):
    white = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = collections.defaultdict(set)
    for number, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(white).translate(lower)
            if len(key) >= 40:
                holders[key].add((number, text))
    result = []
    for number, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            found = holders.get(line.strip(white).translate(lower), ())
            ids = [holder for holder, _ in found if holder is not None]
            if len(found) < 5 or number == max(ids, default=None):
                kept.append(line)
        result.append((number, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return collections.Counter(result)


def test_lines_of_odd_rows(odd):
    found = collections.Counter(map(tuple, line_dedup.digests(odd).collect()))
    assert found == slow_lines(ODD)
    assert line_dedup.digests(odd.where("false")).count() == 0


def test_batches_and_levels_change_no_row(spark, documents):
    text = F.concat_ws("\n", "text", F.lit(LINE), F.concat(F.lit(LINE), F.col("doc_id") % 30))
    many = documents.select("doc_id", text.alias("text"))
    expected = slow_lines([tuple(row) for row in many.collect()])
    for batches in (1, 2, 9):
        found = line_dedup.drop_common_lines(many, batches=batches).select(
            "id", "n_lines", "n_dropped", F.sha2("kept_text", 256)
        )
        assert collections.Counter(map(tuple, found.collect())) == expected


def test_runs_are_merged_level_by_level_and_never_share_a_hash(spark):
    index = line_dedup.LineRuns(spark, fanout=2)
    columns = "hash bigint, check bigint, documents bigint, holder bigint"
    seen = collections.Counter()
    for batch in range(7):
        rows = [(h, -h, 1 + h % 2, 100 - batch) for h in range(batch, batch + 20)]
        seen.update({row[0]: row[2] for row in rows})
        index.add(spark.createDataFrame(rows, columns))
    assert index.levels() == [2, 1, 0]
    held = {row.hash: row.holder for row in index.runs().collect()}
    assert held == {h: 100 - max(0, h - 19) for h in range(26)}
    assert index.runs().count() == len(held)
    common = {row.hash for row in index.common(6).collect()}
    assert common == {h for h, count in seen.items() if count >= 6}


def test_all_copies_in_one_batch(spark):
    frame = spark.range(8).select(F.col("id").alias("doc_id"), F.lit(LINE).alias("text"))
    dropped = {r.id: r.n_dropped for r in line_dedup.drop_common_lines(frame, batches=1).collect()}
    assert dropped == {number: int(number < 7) for number in range(8)}


# --- collocations ---------------------------------------------------------------------


def slow_phrases(rows, max_words, least, percent, top):
    counts, totals = collections.Counter(), collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, max_words + 1):
                for start in range(len(words) - size + 1):
                    counts[lang, tuple(words[start : start + size])] += 1
    found = collections.defaultdict(list)
    longest = collections.Counter()
    for (lang, phrase), a in counts.items():
        if a >= least and len(phrase) > 2:
            for size in range(2, len(phrase)):
                for start in range(len(phrase) - size + 1):
                    part = lang, phrase[start : start + size]
                    longest[part] = max(longest[part], a)
    for (lang, phrase), a in counts.items():
        if a < least or len(phrase) < 2 or 100 * longest[lang, phrase] >= percent * a > 0:
            continue
        cuts = []
        for cut in range(1, len(phrase)):
            left, right = counts[lang, phrase[:cut]], counts[lang, phrase[cut:]]
            cuts.append((1_000_000 * a * a // (left * right), cut, left, right))
        score, _, left, right = min(cuts)
        found[lang].append((-score, -a, " ".join(phrase).encode(), left, right))
    return {
        (lang, rank, phrase.decode(), -a, left, right, totals[lang], -score)
        for lang, own in found.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1)
    }


@pytest.mark.parametrize("max_words, least, top", [(3, 10, 2000), (2, 3, 50), (4, 4, 300)])
def test_phrases_of_the_documents_are_those_of_brute_force(documents, max_words, least, top):
    rows = documents.select("text", "lang").collect()
    found = collocations.collocations(
        documents, max_words=max_words, least=least, top=top, shard_words=5_000
    )
    expected = slow_phrases([tuple(row) for row in rows], max_words, least, 50, top)
    assert len(expected) > 50
    assert set(map(tuple, found.collect())) == expected


def test_phrases_of_odd_rows(odd):
    rows = [(text, (None, "en", "und")[place % 3]) for place, (_, text) in enumerate(ODD)]
    found = collocations.collocations(odd, least=2)
    assert set(map(tuple, found.collect())) == slow_phrases(rows, 3, 2, 50, 2000)
    assert collocations.collocations(odd.where("false")).count() == 0


def test_filter_lets_all_frequent_phrases_through_however_full_it_is(documents, monkeypatch):
    expected = set(map(tuple, collocations.collocations(documents).collect()))
    full = np.full(1 << (collocations._FILTER_BITS - 3), 255, np.uint8)
    monkeypatch.setattr(collocations, "_filter_of", lambda frequent: full)
    assert set(map(tuple, collocations.collocations(documents).collect())) == expected


def test_a_task_reads_its_shards_one_by_one(documents, monkeypatch):
    """All rows of a row group are decoded at once, so shards must not share one."""
    paths = []

    def noted(frame, purpose, *args, **options):
        frame = collocations_stored(frame, purpose, *args, **options)
        if purpose == "phrase-indexes":
            paths.extend(frame.inputFiles())
        return frame

    collocations_stored = collocations.stored
    monkeypatch.setattr(collocations, "stored", noted)
    collocations.phrase_counts(documents.coalesce(1), shard_words=5_000)
    files = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in paths]
    assert max(file.num_rows for file in files) > 1
    for file in files:
        assert {file.row_group(n).num_rows for n in range(file.num_row_groups)} == {1}


def test_scores_past_64_bits_are_exact(spark):
    big = 3_000_000_000_000
    one = spark.createDataFrame([("en", "a", big), ("en", "b", big - 1)], "lang string, phrase string, count bigint")
    two = spark.createDataFrame([("en", "a b", big - 7)], one.schema)
    row = collocations._scored([one, two], 2).first()
    assert row.score == 1_000_000 * (big - 7) ** 2 // (big * (big - 1))


def test_rotations_are_sorted_as_deep_as_asked():
    symbols = np.random.default_rng(8).integers(0, 3, 200).astype(np.int32)
    for depth in (1, 2, 3, 5):
        twice = np.concatenate([symbols, symbols]).tolist()
        order = collocations.rotation_order(symbols, depth)
        keys = [twice[place : place + depth] for place in order.tolist()]
        assert keys == sorted(keys)


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_line_dedup", "op13_collocations"])
def test_registered_queries_cover_every_document(spark, documents, name):
    found = queries.QUERIES[name](spark, SF)
    if "doc_id" in found.columns:
        assert found.count() == documents.count()
    else:
        assert set(found.select("lang").distinct().toPandas().lang) <= {"en", "de", "fr", "es"}


def test_lines_need_no_python(spark):
    plan = queries.QUERIES["op12_line_dedup"](spark, SF)._jdf.queryExecution().executedPlan()
    assert not re.search("EvalPython|InPandas|InArrow|Cartesian|NestedLoop", plan.toString())


# --- hashes of slices -----------------------------------------------------------------


def clashing():
    """Two texts of 4096 letters that every polynomial modulo 2^64 hashes alike."""
    bits = [bin(number).count("1") % 2 for number in range(4096)]
    return "".join("aq"[bit] for bit in bits), "".join("qa"[bit] for bit in bits)


def test_clashing_texts_have_ids_shingles_and_links_of_their_own(spark):
    one, other = clashing()
    rows = [(1, one), (2, other), (3, f"x {one} y z"), (4, f"x {other} y z"), (5, one)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {row.id: row for row in bpe.digests(frame, queries.RANKS).collect()}
    for number, text in rows:
        assert found[number].decoded_sha256 == sha(text)
    pieces = packing.pack(frame, queries.TOKENIZER).groupBy("id").agg(F.sort_array(F.collect_list("ids_crc32")).alias("c"))
    crcs = {row.id: row.c for row in pieces.collect()}
    assert crcs[1] == crcs[5] != crcs[2] and crcs[3] != crcs[4]
    linked = {row.id: row.component_id for row in near_duplicates(frame, Likeness(words=3, percent=85)).collect()}
    assert linked == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_pieces_under_one_hash_keep_their_own_ids(monkeypatch):
    encoder = bpe.Encoder(bpe.Vocabulary.read(queries.RANKS))
    texts = [b"some words of one text", b"and others, of another", b"some words again"]
    expected = [ids.tolist() for _, ids in bpe.encoded(texts, encoder)]
    encoder = bpe.Encoder(bpe.Vocabulary.read(queries.RANKS))
    monkeypatch.setattr(encoder, "_hash", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    assert [ids.tolist() for _, ids in bpe.encoded(texts, encoder)] == expected
