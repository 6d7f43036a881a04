"""Every operator against brute force or an oracle, and on odd tables."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from logloom.llm import (
    bpe,
    chat,
    exact_dedup,
    fingerprints,
    near_dedup,
    packing,
    quality,
    queries,
    secrets,
    tables,
    toxicity,
    url_filter,
)

SF = "/root/testdata/sf0.001"
WORDS = "the of alpha beta gamma delta river stone cloud lamp winter garden".split()


def prose(seed, size=120):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, size).tolist())


LONG = prose(1, 30_000)
ODD = [
    (1, prose(2)),
    (1, prose(2)),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (None, "text without an id"),
    (5, LONG),
    (6, LONG + " end"),
    (7, "x" * 50_000),
    (8, "été 中文 \U0001f600 <|endoftext|> it's"),
    (9, "  ".join(prose(2).split())),
]
SCHEMA = "doc_id bigint, text string, lang string, id string, node string, key int, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(number, text, "en", "a", "b", 1, "c") for number, text in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (5, 1, 0), (6, 0, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def ranks():
    with open(queries.RANKS, "rb") as lines:
        return {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={}
    )


# --- 9 and 2: tokens --------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, tik):
    parts = ["'s", "'ll", "'", " ", "\n", "\r\n", "a", "THE", "é", "中", "12", "!", "\x1c", "\u3000", "re"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(2000)]
    encoder = bpe.Encoder(bpe.Vocabulary.read(queries.RANKS))
    for place, ids in bpe.encoded([text.encode() for text in texts], encoder):
        assert ids.tolist() == tik.encode_ordinary(texts[place])
    got = bpe.digests(odd, queries.RANKS).collect()
    assert len(got) == len(ODD)
    want = {}
    for number, text in ODD:
        ids = tik.encode_ordinary(text or "")
        want[number, len(ids)] = (
            hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )
    assert {(r["id"], r["n_tokens"]): (r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_bpe_round_trip_and_offsets(odd):
    tokens = bpe.encode(odd, queries.RANKS)
    texts = sorted((text or "") for _, text in ODD)
    assert sorted(r["data"].decode() for r in bpe.decode(tokens, queries.RANKS).collect()) == texts
    row = tokens.where("id = 8").first()
    assert row["offsets"][0] == 0 and row["offsets"] == sorted(row["offsets"])


def check_packing(rows, expected):
    sequences, texts = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        texts.setdefault(r["id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.WINDOW
    for number, ids in expected:
        own = np.array([*ids, packing.END_ID], "<u4")
        for start, length, crc, total in texts[number]:
            assert total == len(own) and crc == zlib.crc32(own[start : start + length].tobytes())
    return [sum(length for _, length in pieces) for pieces in sequences.values()]


def test_packing(spark, odd, empty):
    library = Tokenizer.from_file(queries.TOKENIZER)

    def ids(text):
        return library.encode(text or "", add_special_tokens=False).ids

    check_packing(packing.pack(odd, queries.TOKENIZER).collect(), [(n, ids(t)) for n, t in ODD])
    assert packing.pack(empty, queries.TOKENIZER).count() == 0
    filled = check_packing(packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), queries.TOKENIZER).collect(), [])
    padding = sum(0 if size & (size - 1) == 0 else packing.WINDOW - size for size in filled)
    assert padding < 0.05 * sum(filled)


def test_packing_cuts_pieces_that_do_not_complement_each_other(spark):
    library = Tokenizer.from_file(queries.TOKENIZER)
    word = " the"
    assert len(library.encode(word * 10, add_special_tokens=False).ids) == 10
    rows = [(n, word * (1500 if n % 3 else 1300)) for n in range(300)]
    rows += [(0, rows[0][1]), (None, rows[1][1])]
    documents = spark.createDataFrame(rows, "doc_id int, text string")
    packed = packing.pack(documents, queries.TOKENIZER).collect()
    expected = [(n, library.encode(t, add_special_tokens=False).ids) for n, t in rows]
    filled = check_packing(packed, expected)
    assert sum(filled) == sum(len(ids) + 1 for _, ids in expected)
    assert sum(packing.WINDOW - size for size in filled) < 0.04 * sum(filled)
    starts = sorted((r["start"], r["length"]) for r in packed if r["id"] == 5)
    assert starts[0][0] == 0 and sum(length for _, length in starts) == len(expected[5][1]) + 1


# --- 1: near-duplicates -------------------------------------------------------------


def brute_components(rows, words, percent):
    def shingles(text):
        own = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        if len(own) < words:
            return {tuple(own)} if own else set()
        return {tuple(own[i : i + words]) for i in range(len(own) - words + 1)}

    sets = [shingles(text) for _, text in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (number, _), group in zip(rows, label):
        least[group] = min(number, least.get(group, number))
    return {number: (len(own), least[group]) for (number, _), own, group in zip(rows, sets, label)}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for base in range(12):
        words = prose(100 + base, 150).split()
        for copy in range(8):
            changed = list(words)
            for place in rng.integers(0, 150, copy):
                changed[place] = f"w{rng.integers(1000)}"
            rows.append((len(rows), " ".join(changed)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one TWO"), (len(rows) + 3, "one two")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for words, percent in ((3, 85), (5, 80)):
        found = near_dedup.near_duplicates(frame, near_dedup.Likeness(words, percent)).collect()
        want = brute_components(rows, words, percent)
        assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
        assert all(r["kept"] == (r["id"] == r["component_id"]) for r in found)


def test_components_join_a_link_once(spark, monkeypatch):
    """What one round leaves of the links is stored for the next, not all links again."""
    rng = np.random.default_rng(5)
    hubs = [(int(n), int(hub)) for n in range(100, 2100) for hub in rng.choice(20, 4, False)]
    names = rng.permutation(300) + 10_000
    paths = [(int(names[n]), int(names[n + 1])) for n in range(299)]
    climb = [(20_000 + n, 20_001 + n) for n in range(300)]
    star = [(30_000 + n, 30_500) for n in range(300)]
    links = hubs + paths + climb + star
    over = {n: n for link in links for n in link}

    def top(n):
        while over[n] != n:
            over[n] = n = over[over[n]]
        return n

    for one, other in links:
        low, high = sorted((top(one), top(other)))
        over[high] = low
    again = []

    def counted(frame, purpose, *rest):
        done = tables.stored(frame, purpose, *rest)
        if purpose == "links":
            again.append(done.count())
        return done

    monkeypatch.setattr(near_dedup, "stored", counted)
    frame = spark.createDataFrame(links, "node bigint, other bigint")
    found = near_dedup.components(frame).collect()
    assert {row.node: row.component for row in found} == {n: top(n) for n in over}
    assert len(found) == len(over)
    assert sum(again) < len(links) / 2, "links that lie inside a group are gone after a round"


def test_near_duplicates_on_odd_rows(odd, empty):
    found = near_dedup.near_duplicates(odd).collect()
    assert len(found) == len(ODD)
    by_id = {r["id"]: r for r in found}
    assert by_id[9]["component_id"] == 1 and by_id[6]["component_id"] == 5
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert all(by_id[n]["n_shingles"] == 0 and by_id[n]["kept"] for n in (2, 3, 4))
    kept = near_dedup.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 2
    assert near_dedup.near_duplicates(empty).count() == 0


# --- 7: exact duplicates --------------------------------------------------------------


def test_exact_duplicates(odd, empty):
    found = {r["id"]: r for r in exact_dedup.exact_duplicates(odd).collect()}
    assert found[9]["kept"] and found[1]["keep_id"] == 9 and found[1]["group_size"] == 3
    assert {found[n]["keep_id"] for n in (2, 3, 4)} == {4}
    assert found[None]["kept"]
    kept = exact_dedup.without_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 4
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_directory_doubles_overfull_buckets_only(spark):
    def keys(counts):
        rows = [(((cell << 61) + n + 2**63) % 2**64 - 2**63,) for cell, held in counts.items() for n in range(held)]
        return spark.createDataFrame(rows, "key bigint")

    counts = {0: 5, 1: 5, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    cells, depth = exact_dedup.directory(keys(counts), bucket=5)
    buckets = {r["cell"]: r["bucket"] for r in cells.collect()}
    assert depth == 3 and len(buckets) == 8
    assert buckets[0] != buckets[1] and len({buckets[cell] for cell in range(4, 8)}) == 1
    same = spark.createDataFrame([(7,)] * 99, "key bigint")
    cells, depth = exact_dedup.directory(same, bucket=5)
    assert cells.count() == 1
    assert exact_dedup.directory(same.where("false"), bucket=5)[0].count() == 0


def test_clashing_keys_and_overfull_buckets(spark, odd):
    texts = [f"text {n % 60}" for n in range(300)] + ["text  7", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").union(
        odd.select("doc_id", "text"))
    want = sorted(map(str, exact_dedup.exact_duplicates(frame).collect()))
    few = lambda bare: F.pmod(F.xxhash64(bare), F.lit(7))
    clashing = exact_dedup.exact_duplicates(frame, key=few, bucket=3)
    assert sorted(map(str, clashing.collect())) == want
    assert sorted(map(str, exact_dedup.exact_duplicates(frame, bucket=3).collect())) == want
    assert sum(r["group_size"] == 6 for r in clashing.collect()) == 6


# --- 5: secrets -----------------------------------------------------------------------


def brute_secrets(text):
    found = []
    pattern = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(pattern, text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    for rank, kind, form, least in ((1, "access", "AKIA[A-Z0-9]+", 20), (2, "hex", "[0-9a-f]+", 24)):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(form, text) if len(m[0]) >= least]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def test_secrets_equal_brute_force(spark, odd, empty):
    rng = np.random.default_rng(8)
    parts = ["password", "API_KEY", "apikey", "Token", "=", ": ", "'", '"', "é", "abc123", "AKIA", " ",
             "0123456789abcdef" * 2, "ABCDEFGH12345678", "secret=hunter22", "\n", "=="]
    rows = [(n, "".join(rng.choice(parts, rng.integers(1, 25)))) for n in range(400)]
    rows += [(1000 + n, text) for n, (_, text) in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r for r in secrets.digests(frame).collect()}
    for number, text in rows:
        base = brute_secrets(text or "")
        assert got[number]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[number]["spans"].split(","))
    assert secrets.digests(odd).count() == len(ODD) and secrets.digests(empty).count() == 0


def test_random_tokens_are_told_from_words(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    tokens = ["".join(rng.choice(letters, 64)) + "7a" for _ in range(20)]
    words = ["".join(rng.choice(["the", "tion", "er", "an", "re"], 22)) for _ in range(400)]
    frame = spark.createDataFrame(
        [(n, f"see {t} now") for n, t in enumerate(tokens)] + [(100 + n, w) for n, w in enumerate(words)],
        "doc_id bigint, text string",
    )
    found = {r["id"]: r["random"] for r in secrets.secrets(frame).collect()}
    assert sum(bool(found[n]) for n in range(20)) >= 16
    assert not any(found[100 + n] for n in range(400))
    clean = {r["doc_id"]: r["text"] for r in secrets.masked(frame).collect()}
    hit = next(n for n in range(20) if found[n])
    assert clean[hit] == "see [random] now" and clean[100] == words[0]


def test_random_keys_are_found_without_long_words(spark):
    rng = np.random.default_rng(6)
    lower = "abcdefghijklmnopqrstuvwxyz"
    both = lower + lower.upper() + "0123456789"
    keys = []
    for alphabet in ("0123456789ABCDEF", both, both + "+/"):
        for size in (24, 32, 44, 64):
            keys += ["".join(rng.choice(list(alphabet), size - 2)) + "7A" for _ in range(5)]
    plain = ["docs/reports/annual/letters-to-the-members-2", "the_number_of_the_letters_in_the_tree_2",
             "abcdefghijklmnopqrstuvwxyz0123456789", "a1" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaa1"]
    texts = [f"{prose(7, 20)} {key} {prose(8, 20)}" for key in keys + plain]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["id"]: r["random"] for r in secrets.secrets(frame).collect()}
    assert sum(bool(found[n]) for n in range(len(keys))) >= 0.9 * len(keys)
    assert not any(found[len(keys) + n] for n in range(len(plain)))
    clean = {r["doc_id"]: r["text"] for r in secrets.masked(frame).collect()}
    hit = next(n for n in range(len(keys)) if found[n])
    assert clean[hit] == texts[hit].replace(keys[hit], "[random]")


NAMES = """getUserAccountById2Name TransactionProcessor2024Impl Section4ParagraphTwoSubsectionB
AbstractSingletonProxyFactoryBean2 readNumberOfOpenConnections max_number_of_retries_3 the-garden-of-stones-2021
HttpServletRequestWrapperTest internationalization_utils_v2 org/example/project/module/Main2
updateCustomerAddress2Line handleIncomingMessageV3Event""".split()


def test_ordinary_names_are_not_reported(spark):
    rng = np.random.default_rng(11)
    both = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = ["".join(rng.choice(both, size)) for size in (24, 28, 32, 40) for _ in range(10)]
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    added = [(-1 - n, f"see {token} here") for n, token in enumerate(keys + NAMES)]
    for times in (1, 5):  # one rule, however many names there are
        more = [(number - 10_000 * again, text) for again in range(times) for number, text in added]
        frame = documents.union(spark.createDataFrame(more, documents.schema))
        found = {r["id"]: r["random"] for r in secrets.secrets(frame).where("id < 0").collect()}
        assert sum(bool(found[-1 - n]) for n in range(len(keys))) >= 0.9 * len(keys)
        assert [name for n, name in enumerate(NAMES) if found[-1 - len(keys) - n]] == []


def test_evidence_equals_brute_force(spark):
    frame = spark.createDataFrame([(1, "river stoneCloud xé River"), (2, None), (3, "")], "doc_id bigint, text string")
    chances = secrets.letter_chances(frame)
    counts = {}
    for word in {"river", "stone", "cloud"}:
        for a, b in zip("^" + word, word):
            counts[a + b] = counts.get(a + b, 0) + 1
    letters = "abcdefghijklmnopqrstuvwxyz"
    alone = np.array([sum(n for pair, n in counts.items() if pair[1] == b) for b in letters]) / 15
    for i, a in enumerate("^" + letters):
        own = np.array([counts.get(a + b, 0) for b in letters])
        own = own / own.sum() if own.sum() else alone
        mixed = np.array(secrets.SHARES) @ np.array([own, alone, np.full(26, 1 / 26)])
        assert np.allclose(chances[26 * i:26 * i + 26], np.log(mixed))

    def brute(token, size):
        total, last = 0.0, (0, "")
        for c in token:
            kind = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4
            total += math.log(secrets.TURNS[last[0]][kind - 1])
            before = "" if (last[0], kind) == (1, 2) else last[1]
            if c.isalpha():
                total += chances[26 * (1 + letters.index(before) if before else 0) + letters.index(c.lower())]
            else:
                total += math.log(1 / 10 if kind == 3 else 1 / 4)
            last = (kind, c.lower() if c.isalpha() else "")
        return max(0, math.floor(100 * (-math.log(size) * len(token) - total) / math.log(10)))

    tokens = {"qXz9Kw3RvT7bLm2PfGh4": 62, "riverStoneCloud2": 62, "QZ7XJ2KQ": 32, "a/b+c9Z": 64}
    row = spark.createDataFrame([(list(tokens),)], "t array<string>").select(
        secrets._evidence(F.col("t"), chances)).first()[0]
    assert row == [brute(token, size) for token, size in tokens.items()]


# --- 6: fingerprints --------------------------------------------------------------------


def test_fingerprints_are_homomorphic(spark):
    one, other = "Alpha. Beta.\nGamma", "Delta.\nEpsilon. Beta."
    rows = [(1, one), (2, other), (3, "Gamma\nBeta.\nAlpha."), (4, f"{other}\n{one}"), (5, one)]
    frame = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    lanes = {r["id"]: (r["lanes"], r["fingerprint"]) for r in frame.collect()}
    assert lanes[1] == lanes[3] == lanes[5] and lanes[1] != lanes[2]
    row = spark.createDataFrame([(lanes[1][0], lanes[2][0], lanes[4][0])], "a array<long>, b array<long>, c array<long>")
    row = row.select(
        fingerprints.combined(F.col("a"), F.col("b")).alias("sum"),
        fingerprints.combined(F.col("c"), F.col("b"), -1).alias("rest"),
        fingerprints.likeness(F.col("a"), F.col("a")).alias("same"),
        fingerprints.likeness(F.col("a"), F.col("b")).alias("near"),
    ).first()
    assert row["sum"] == lanes[4][0] and row["rest"] == lanes[1][0]
    assert row["same"] == 1.0 and 0 <= row["near"] < 0.8


def test_edits_take_from_the_next_document(odd, empty):
    rows = {}
    for r in fingerprints.compare_with_next(odd).collect():
        rows.setdefault(r["id"], []).append(r)
    order = [None, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    text = {number: own or "" for number, own in ODD}
    for number, following in zip(order, order[1:] + order[:1]):
        half = len(text[number]) // 2
        edited = text[number][: len(text[number]) - half] + text[following][:half]
        for r in rows[number]:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert r["n_chars"] == len(text[number])
    assert sum(map(len, rows.values())) == len(ODD)
    assert fingerprints.compare_with_next(empty).count() == 0


# --- 8: urls ----------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "HTTPS://WWW.Spam-Farm.Example.ORG/en/1?x"), (2, None), (3, "no scheme"), (4, "a://x.NET"),
        (5, "a://b.example.net/en/q#f"), (6, "a://example.com/de/"), (7, "a://net/"), (8, "://org/fr/x://y"),
        (9, "a://casino-win.example.com?/de/"), (9, "a://casino-win.example.com?/de/"), (10, ""),
    ]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id bigint, url string, host string, listed string")
    names = url_filter.listed_hosts(pages)
    got = url_filter.judge(pages, names).collect()
    connection = duckdb.connect()
    connection.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    connection.executemany("INSERT INTO pages VALUES (?, ?)", rows[:1] + [r for r in rows[1:] if r[1] is not None])
    want = sorted(map(str, connection.sql(url_filter.ORACLE).fetchall()))
    assert sorted(str(tuple(r)) for r in got if r["id"] != 2) == want
    assert [tuple(r) for r in got if r["id"] == 2] == [(2, "", "", None, "allow")]
    joined = url_filter.judge(pages, names, mapped=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert url_filter.judge(pages.where("false"), names).count() == 0


def test_digest_array(tmp_path):
    file = tmp_path / "array"
    file.write_bytes(url_filter.DigestArray.pack(["a.b", "é", "", "c"]))
    array = url_filter.DigestArray(str(file))
    assert array.contains(["a.b", "x", "", "é"]).tolist() == [True, False, True, True]
    file.write_bytes(url_filter.DigestArray.pack([]))
    assert not url_filter.DigestArray(str(file)).contains(["a"]).any()


# --- 10: quality ---------------------------------------------------------------------------


def test_quality(spark, odd, empty, labels):
    documents = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    known = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    found = quality.classify(documents, known)
    rates = {r["quality"]: r["kept"] for r in found.join(known, found["id"] == known["doc_id"])
             .groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.98 and rates[0] < 0.35
    assert quality.classify(odd, labels).count() == len(ODD)
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(odd, labels.where("false")).where("NOT kept").count() == 0
    assert quality.without_low_quality(odd, labels).columns == odd.columns


def kneser_ney(texts):
    """The model of ``quality`` over plain strings of bytes, by its textbook definition."""
    mark, size = bytes([quality.MARK]), quality.ORDER
    counts = {size: {}}
    for text in texts:
        row = mark * (size - 1) + text + mark
        for end in range(size, len(row) + 1):
            gram = row[end - size : end]
            counts[size][gram] = counts[size].get(gram, 0) + 1
    for order in range(size - 1, 0, -1):
        counts[order] = {}
        for gram in counts[order + 1]:
            counts[order][gram[1:]] = counts[order].get(gram[1:], 0) + 1
    cuts, totals = {}, {}
    for order, own in counts.items():
        n = [sum(value == k for value in own.values()) for k in range(5)]
        cuts[order] = [0.5, 0.75, 0.9]
        if all(n[1:]):
            y = n[1] / (n[1] + 2 * n[2])
            raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
            cuts[order] = [min(max(v, 0.05), k - 0.05) for k, v in zip((1, 2, 3), raw)]
        for gram, value in own.items():
            total, taken = totals.get(gram[:-1], (0, 0))
            totals[gram[:-1]] = total + value, taken + cuts[order][min(value, 3) - 1]

    def share(gram):
        if not gram:
            return 1 / 256
        shorter = share(gram[1:])
        if gram[:-1] not in totals:
            return shorter
        total, taken = totals[gram[:-1]]
        own = counts[len(gram)].get(gram, 0)
        seen = max(own - cuts[len(gram)][min(own, 3) - 1], 0) if own else 0
        return seen / total + taken / total * shorter

    return share


def test_kneser_ney_equals_brute_force(spark):
    texts = [prose(n, 30 + n) for n in range(40)] + ["", "été 😀", "a" * 50]
    rows = [(n, n, "en", n % 2 == 0, n % 2 == 0, text) for n, text in enumerate(texts)]
    rows += [(-1, -1, None, False, False, None), (None, -2, "xx", False, False, "new words, unseen")]
    documents = spark.createDataFrame(
        rows, "id int, text_key bigint, lang string, trusted boolean, counted boolean, text string"
    ).repartition(3)
    held = quality.blocks(documents)
    model = quality.train(quality.count_grams(held)).cache()
    share = kneser_ney([text.encode() for text in texts[::2]])

    shares = {row["key"]: row["p"] for row in model.collect()}
    for text in ("alpha", "the r", "é 😀"[:3]):
        gram = text.encode()[: quality.ORDER]
        key = int.from_bytes(gram, "big") | len(gram) << quality.KEY_BITS
        if shares.get(key) is not None:
            assert math.isclose(shares[key], share(gram), rel_tol=1e-9)
    mark = bytes([quality.MARK])
    found = {row["text_key"]: row for row in quality.surprise(held, model).collect()}
    assert len(found) == len(rows)
    for row in rows:
        text = mark * 4 + (row[5] or "").encode() + mark
        bits = -sum(math.log2(share(text[end - 5 : end])) for end in range(5, len(text) + 1))
        assert math.isclose(found[row[1]]["bits"], bits, rel_tol=2e-3)
        assert found[row[1]]["n_bytes"] == len(text) - 5 and found[row[1]]["id"] == row[0]
    assert math.isclose(sum(share(b"alph" + bytes([n])) for n in range(256)), 1, rel_tol=1e-9)


def test_blocks_of_any_size_give_the_same_scores(spark, labels, monkeypatch):
    documents = spark.createDataFrame(
        [(n % 25, prose(n, 5 * n), "en") for n in range(60)], "doc_id int, text string, lang string"
    )

    def scores():
        found = quality.classify(documents, labels).collect()
        return sorted((r["id"], r["n_bytes"], round(r["score"], 9), r["kept"]) for r in found)

    want = scores()
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    assert scores() == want
    monkeypatch.setattr(tables, "LABELS_SENT", 0)
    assert scores() == want


def test_texts_in_blocks_are_not_moved_to_their_answers(spark, labels, monkeypatch):
    documents = spark.createDataFrame(
        [(n, prose(n, 50), "en") for n in range(40)], "doc_id int, text string, lang string"
    )
    plans, stored = {}, quality.stored

    def noted(frame, purpose, **options):
        plans[purpose] = frame._jdf.queryExecution().executedPlan().toString()
        return stored(frame, purpose, **options)

    monkeypatch.setattr(quality, "stored", noted)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    entries = {row.name for row in spark.catalog.listTables()}
    assert quality.classify(documents, labels).count() == 40
    assert {row.name for row in spark.catalog.listTables()} == entries
    to_texts, scan, _ = plans["surprise"].split("FlatMapCoGroupsInArrow")[1].partition("FileScan")
    assert scan and "Exchange" not in to_texts
    assert "Bucketed: true" in plans["surprise"]


def test_quality_keeps_columns_of_any_name(spark, odd, labels):
    clashing = odd.withColumnsRenamed({"id": "text_key", "node": "gone_id", "kept": "found"})
    for rows in (secrets.masked(clashing), exact_dedup.without_exact_duplicates(clashing)):
        assert rows.columns == clashing.columns and rows.count() > 0
    clashing = clashing.withColumn("rows", F.lit(1)).withColumn("rejected", F.lit(2))
    assert quality.without_low_quality(clashing, labels).columns == clashing.columns


# --- 3: toxicity ------------------------------------------------------------------------------


def test_misspellings_are_found():
    trie = toxicity.Trie(["idiot", "scum", "lowei*"])
    for word, kind in (("idiot", 0), ("scum", 0), ("idit", 2), ("idiott", 2), ("ixiot", 2), ("loweiung", 1)):
        assert trie.find(word)[1] == kind
    assert not any(trie.find(word) for word in ("id", "idle", "scu", "lowe", "radio", "patriot"))


def test_misspellings_with_digits_and_signs_are_found():
    scanner = toxicity.Scanner(["idiot", "moron", "stupid", "loser", "scum", "ass"])
    fuzzy = toxicity.FEATURES.index("fuzzy")
    for word in ("id1ot", "mor0n", "st*pid", "l_ser", "1diot", "(Mor0n!)", "you/id1ot,", "sc*m", "scu7", "scam", "a$s"):
        assert scanner.features(f"what a {word} it is")[fuzzy] == math.log1p(1), word
    for word in ("id-it-s", "sum", "cum", "asp", "e-mail", "it's", "x1", "m0r0n"):
        assert not any(scanner.features(f"what a {word} it is")), word
    assert scanner.features("an idiot's 2nd idiot2")[:3] == [math.log1p(2), 0, 0]


def test_terms_are_chosen_by_evidence_not_share(spark):
    rows = [(f"{prose(n, 8)} {'zuffig' if n < 12 else ''}", 1, "en") for n in range(4000)]
    rows += [(prose(n, 8), 0, "en") for n in range(6000)]
    rows += [(f"cosa {'tarugo' if n < 8 else ''} {prose(n, 3)}", int(n < 40), "es") for n in range(160)]
    rows += [(f"woord {prose(n, 3)}", 1, "nl") for n in range(30)]
    labelled = spark.createDataFrame(rows, "text string, toxic int, lang string")
    lexicon = toxicity.learn_lexicon(labelled)
    assert any(term.startswith("zuff") for term in lexicon)
    assert any(term.startswith("taru") for term in lexicon)
    assert not any(term.startswith(("woor", "cosa", "rive")) for term in lexicon)


def test_toxicity(spark, odd, empty, labels):
    documents = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")
    known = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    found = toxicity.score(documents, known)
    rows = found.join(known, found["id"] == known["doc_id"]).where("held_out").collect()
    assert all((zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)
    hits = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hits / sum(r["toxic"] for r in rows) > 0.8 and hits / sum(r["predicted"] for r in rows) > 0.95
    scores = toxicity.score(odd, labels).collect()
    assert len(scores) == len(ODD) and all(0 <= r["score"] <= 1 for r in scores)
    assert toxicity.score(empty, labels).count() == 0


# --- 4: chat ---------------------------------------------------------------------------------


SUMS = {"add": {"x": "integer", "y": "number"}}
MESSAGE = "role string, call_id string, after string, tool string, arguments string, content string"


def test_calls_are_linked_ordered_and_checked(spark):
    calls = [("a", None, "add", '{"y":2,"x":1}'), ("b", "a", "add", '{"x":"1","y":2}'), ("c", "b", "add", "[1]"),
             ("d", "e", "add", None), ("e", "d", "sub", "{}"), (None, None, "add", '{"x":1,"y":2}'), ("f", "zz", "add", "{")]
    results = [("a", 'say "x"'), ("a", "z"), ("q", "?"), (None, "n")]
    frame = spark.createDataFrame(
        [("assistant", *call, None) for call in calls]
        + [("tool", name, None, None, None, content) for name, content in results]
        + [("system", "a", None, None, None, "be kind"), (None,) * 6],
        MESSAGE,
    )
    rows = chat.link(frame, SUMS).collect()
    assert len(rows) == len(calls) + len(results) + 2
    got = {r["call_id"]: r for r in rows if r["tool"]}
    assert {c: got[c]["position"] for c in "abcdef"} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": 0}
    assert [got[c]["error"] for c in "abcdef"] == [
        None, "x must be integer", "arguments must be an object", "arguments must be an object", "unknown tool",
        "arguments must be an object"]
    assert got["a"]["results"] == 2 and got["b"]["results"] == 0 and got[None]["error"] is None
    assert got["a"]["json"] == '{"arguments":{"x":1,"y":2},"id":"a","name":"add","position":0}'
    assert got["a"]["status"] == "answered" and got["b"]["status"] == "unanswered"
    answers = {r["content"]: r for r in rows if r["role"] == "tool"}
    assert answers['say "x"']["json"] == '{"content":"say \\"x\\"","id":"a","position":0}'
    assert [answers[c]["status"] for c in ('say "x"', "z", "?", "n")] == ["linked", "linked", "no call", "no call"]
    others = sorted(r["json"] for r in rows if r["status"] == "message")
    assert others == ['{"content":"be kind","role":"system"}', '{"content":null,"role":null}']


def test_links_keep_columns_and_odd_rows(spark):
    content = "long \U0001f600 " * 50_000
    rows = [("assistant", "a", None, "add", "", None, 1, "p", "s"), ("tool", "a", None, None, None, content, 2, "p", "s"),
            ("tool", "a", None, None, None, content, 2, "p", "s")]
    frame = spark.createDataFrame(rows, MESSAGE + ", row int, position string, `a.b` string")
    got = chat.link(frame, SUMS).collect()
    assert sorted(r["row"] for r in got) == [1, 2, 2] and {r["position"] for r in got} == {0}
    assert {r["a.b"] for r in got} == {"s"} and max(len(r["json"]) for r in got) > len(content)
    assert chat.link(frame.where("false"), SUMS).count() == 0


@pytest.mark.parametrize("written, wanted", [
    ('{"b":100,"a":1e2}', '{"a":100,"b":100}'),
    ("[1E21,1e20,0.000001,1e-7,-0.0,1.50,-12.5e-9,333333333.33333329,123456789012345678]",
     "[1e+21,100000000000000000000,0.000001,1e-7,0,1.5,-1.25e-8,333333333.3333333,123456789012345680]"),
    ("5e-324", "5e-324"),
    ('{"\\u001F 1.50":"\\\\u001F 1e2","é":"1.0"}', '{"\\u001f 1.50":"\\\\u001F 1e2","é":"1.0"}'),
    ('{"a":1,"a":2}', '{"a":2}'),
    (' { "t" : [ true , null , { } ] } ', '{"t":[true,null,{}]}'),
    ("{", None),
])
def test_canonical_json(spark, written, wanted):
    frame = spark.createDataFrame([(written,)], "j string")
    assert frame.select(chat.canonical("j")).first()[0] == wanted


def test_every_turn_is_a_row(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "yo"), (1, 2, "assistant", "also yo"),
             (1, 3, "user", None), (None, 4, "user", "x"), (1, None, "user", "y"), (2, None, "assistant", None),
             (2, 8, "assistant", "alone"), (2, 9, None, "?"), (1, 1, "user", "a")]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    linked = chat.link(chat.messages_of(frame), chat.REPLY)
    linked = linked.withColumn("role", F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role")))
    columns = ["conv_id", "turn", "role", "call_id", *chat.ADDED]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", turns)
    want = connection.sql(f"SELECT {', '.join(columns)} FROM ({chat.ORACLE})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in linked.select(columns).collect())
    assert len(want) == len(turns) and {"yo", "also yo"} <= {r["content"] for r in linked.collect()}


# --- the whole ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, oracle, name):
    frame = queries.QUERIES[name](spark, SF)
    relation = oracle.sql(queries.ORACLES[name])
    columns = sorted(frame.columns)
    assert sorted(relation.columns) == columns
    places = [relation.columns.index(column) for column in columns]
    want = sorted(str(tuple(row[place] for place in places)) for row in relation.fetchall())
    assert sorted(str(tuple(row)) for row in frame.select(columns).collect()) == want


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "secrets", "packing"]
    packed = corpus_pipeline.run(spark, SF).collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0.5 * documents.count() < len({r["doc_id"] for r in packed}) < documents.count()
    assert math.isclose(len({(r["doc_id"], r["start"]) for r in packed}), len(packed))
