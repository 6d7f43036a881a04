"""MinHash near-duplicates by SetSketch registers.

Each register of a text's sketch holds the least value of one hash function over the
text's shingles, turned into an exponential variable and truncated to a power of a base
near one. Two sketches agree in a register about as often as the similarity of the sets,
so bands of register values find candidates; the registers that agree, or lead on one
side, give the likelihood of every similarity, and pairs for which the wanted similarity
is out of the question go; the others are compared on the whole sets.

Texts with equal sets are one class from the start. Within a bucket nobody is paired with
everybody: members are first compared with one leader, then with a few more of other
components; then blocks of nodes that still belong to different components are compared.
A pair inside a component needs no comparison, as it could not change the component; so
every link counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.shingles import Shingler
from logloom.llm.slices import powers, spread, text_bytes
from logloom.llm.tables import stored

#: Sets and sketches of a block that meets other blocks as a whole, in bytes.
BLOCK_BYTES = 4 << 20
#: Times that nodes move to a larger home in reach, so as not to chain groups together.
_MOVES = 2
#: Nodes of a block that are held against another block at once.
_STRIPE = 256


@dataclass(frozen=True)
class Likeness:
    """What counts as a near-duplicate, and how sketches are made for it.

    A link between texts whose similarity is just the limit is missed with a probability
    of ``miss`` by the bands, and about as rarely by the likelihood.
    """

    words: int = 5
    percent: int = 80
    band_rows: int = 6
    miss: float = 1e-7
    base: float = 1.001
    rate: float = 20.0

    @property
    def bands(self) -> int:
        agree = (self.percent / 100) ** self.band_rows
        return math.ceil(math.log(self.miss) / math.log1p(-agree))

    @property
    def registers(self) -> int:
        return self.bands * self.band_rows


class Sketcher:
    def __init__(self, likeness: Likeness) -> None:
        self.likeness = likeness
        count = likeness.registers
        self._factors = spread(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
        rows = likeness.band_rows
        self._rows = spread(powers(0xD1342543DE82EF95, rows + 1)[1:]) | np.uint64(1)
        self._band = spread(np.arange(1, likeness.bands + 1, dtype=np.uint64) << np.uint64(20))

    def registers(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self._factors), np.iinfo(np.uint64).max)
        for begin in range(0, len(shingles), 512):
            block = shingles[begin : begin + 512, None] * self._factors
            np.minimum(least, block.min(axis=0), out=least)
        share = (least.astype(np.float64) + 0.5) / 2.0**64
        exponential = -np.log1p(-np.minimum(share, 1 - 1e-16)) / self.likeness.rate
        level = np.floor(1 - np.log(exponential) / math.log(self.likeness.base))
        return np.clip(level, 0, 65535).astype("<u2")

    def keys(self, registers: np.ndarray) -> np.ndarray:
        """One key per band."""
        banded = registers.astype(np.uint64).reshape(self.likeness.bands, -1)
        return spread((banded * self._rows).sum(axis=1, dtype=np.uint64) ^ self._band)


def may_link(likeness: Likeness, one: np.ndarray, other: np.ndarray, n_one, n_other) -> np.ndarray:
    """Whether sketches leave the wanted similarity possible: rows of registers, set sizes.

    The joint likelihood of a similarity comes from how many registers agree and how many
    are larger on either side. A pair stays unless its best similarity below the limit is
    more likely by a factor of e^14 than any at or above it.
    """
    base = likeness.base
    u = (n_one / (n_one + n_other))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 401)[None, :] * np.minimum(u / v, v / u)

    def part(share: np.ndarray) -> np.ndarray:
        return -np.log1p(-share * (base - 1) / base) / math.log(base)

    more, less = part(np.maximum(u - v * grid, 0)), part(np.maximum(v - u * grid, 0))
    same = 1 - more - less
    tiny = 1e-300
    score = (
        (one > other).sum(1)[:, None] * np.log(np.maximum(more, tiny))
        + (one < other).sum(1)[:, None] * np.log(np.maximum(less, tiny))
        + (one == other).sum(1)[:, None] * np.log(np.maximum(same, tiny))
    )
    limit = likeness.percent / 100
    wanted = np.where(grid >= limit - 0.005, score, -np.inf).max(1)
    return wanted >= score.max(1) - 14


def sketches(documents: DataFrame, likeness: Likeness, id: str, text: str) -> DataFrame:
    """``id, text_key, n_shingles, node, registers, keys``: node is a digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(likeness.words), Sketcher(likeness)
        for batch in batches:
            sets = shingler.sets(text_bytes(batch.column(1)))
            nodes, registers, keys = [], [], []
            for own in sets:
                if len(own):
                    levels = sketcher.registers(own)
                    nodes.append(_node(own))
                    registers.append(levels.tobytes())
                    keys.append(sketcher.keys(levels).view(np.int64))
                else:
                    nodes.append(None)
                    registers.append(None)
                    keys.append(np.zeros(0, np.int64))
            cuts = np.concatenate(([0], np.cumsum([len(own) for own in keys])))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(own) for own in sets], pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(registers, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat)),
                ],
                ["id", "text_key", "n_shingles", "node", "registers", "keys"],
            )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text, F.xxhash64(text)).mapInArrow(
        run,
        f"id {kind}, text_key bigint, n_shingles bigint, node binary, registers binary, "
        "keys array<bigint>",
    )


def _node(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets(
    documents: DataFrame, classes: DataFrame, likeness: Likeness, id: str, text: str
) -> DataFrame:
    """``node, shingles`` of the classes, from the text of the row that names each one.

    Where other rows have the same id, the node tells the right one.
    """
    wanted = classes.select(F.col("id").alias("named"), "node")
    rows = documents.select(F.col(id).alias("named"), F.col(text).alias("whole_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(likeness.words)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                sets = shingler.sets(text_bytes(part.column(1)))
                right = [_node(own) == node for own, node in zip(sets, part.column(0).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([own.tobytes() for own in sets], pa.binary())],
                    ["node", "shingles"],
                ).filter(pa.array(right, pa.bool_()))

    return (
        rows.join(wanted, "named")
        .select("node", "whole_text")
        .mapInArrow(run, "node binary, shingles binary")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles"))
    )


# --- links -----------------------------------------------------------------------


def _likely(pairs: DataFrame, classes: DataFrame, likeness: Likeness) -> DataFrame:
    """Those of the pairs ``node, other`` that the sketches leave possible."""
    own = classes.select("node", "n_shingles", "registers")
    theirs = classes.select(*[F.col(c).alias(f"other_{c}") for c in own.columns])
    with_sketches = (
        pairs.join(own, "node")
        .join(theirs.withColumnRenamed("other_node", "other"), "other")
        .where(
            F.least("n_shingles", "other_n_shingles") * 100
            >= F.greatest("n_shingles", "other_n_shingles") * likeness.percent
        )
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for begin in range(0, len(whole), 1000):
                frame = whole.iloc[begin : begin + 1000]
                one, other = (
                    np.frombuffer(b"".join(frame[c]), "<u2").reshape(len(frame), -1)
                    for c in ("registers", "other_registers")
                )
                sizes = (frame[c].to_numpy(float) for c in ("n_shingles", "other_n_shingles"))
                yield frame.loc[may_link(likeness, one, other, *sizes), ["node", "other"]]

    columns = ["node", "other", "n_shingles", "other_n_shingles", "registers", "other_registers"]
    return with_sketches.select(columns).mapInPandas(run, "node binary, other binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, likeness: Likeness) -> DataFrame:
    """Those of the pairs whose whole sets are alike enough."""
    with_sets = pairs.join(sets, "node").join(
        sets.select(F.col("node").alias("other"), F.col("shingles").alias("others")), "other"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            linked = [_linked(likeness, *pair) for pair in pairs]
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return with_sets.select("node", "other", "shingles", "others").mapInArrow(
        run, "node binary, other binary"
    )


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """``node, component`` of all nodes in ``links`` (node, other): the least node reachable.

    Every round, each node follows the least of its neighbours, and that one's, down to a
    node with no lesser neighbour; the links then hold between the nodes arrived at, those
    inside one and repeated ones go. So a link is joined once, and the next round has only
    what still lies between groups.
    """
    rounds = []
    while True:
        lowest = _lowest(links, purpose)
        rounds.append(lowest)
        ends = lowest.toDF("other", "upper")
        left = (
            links.join(lowest.withColumnRenamed("component", "lower"), "node")
            .join(ends, "other")
            .where("lower <> upper")
            .select(F.least("lower", "upper").alias("node"), F.greatest("lower", "upper").alias("other"))
            .distinct()
        )
        links = stored(left, "links")
        if links.isEmpty():
            break
    found = rounds.pop()
    while rounds:
        beyond = found.toDF("component", "beyond")
        found = stored(
            rounds.pop()
            .join(beyond, "component", "left")
            .select("node", F.coalesce("beyond", "component").alias("component")),
            purpose,
        )
    return found


def _lowest(links: DataFrame, purpose: str) -> DataFrame:
    """``node, component``: where each node ends that follows least neighbours downward."""
    own = links.union(links.select("other", "node")).toDF("node", "other")
    labels = stored(
        own.groupBy("node")
        .agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("component")),
        purpose,
    )
    while True:
        jump = labels.toDF("component", "beyond")
        moved = stored(
            labels.join(jump, "component").select(
                "node",
                F.col("beyond").alias("component"),
                (F.col("beyond") < F.col("component")).alias("moved"),
            ),
            purpose,
        )
        labels = moved.select("node", "component")
        if moved.where("moved").isEmpty():
            return labels


def _bucket_members(classes: DataFrame) -> DataFrame:
    """``key, node, members``: the buckets that hold more than one node."""
    rows = classes.select("node", F.explode("keys").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    return rows.join(sizes, "key")


def _star(buckets: DataFrame, seeds: range) -> DataFrame:
    """Pairs of every member with each leader of its bucket, one leader per seed.

    ``buckets`` has ``key, node, component``; pairs inside a component are left out. A seed
    ranks all nodes alike in every bucket, so that alike buckets have the same leader.
    """
    leaders = buckets.groupBy("key").agg(
        F.array_distinct(
            F.array(
                *[
                    F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("r"), "node", "component"))
                    for seed in seeds
                ]
            )
        ).alias("leaders")
    )
    return (
        buckets.join(leaders, "key")
        .select("node", "component", F.explode("leaders").alias("leader"))
        .where(F.col("component") != F.col("leader.component"))
        .select(
            F.least("node", "leader.node").alias("node"),
            F.greatest("node", "leader.node").alias("other"),
        )
        .distinct()
    )


def _blocks(buckets: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """``node, component, block, unit``: nodes that share buckets, in blocks of about ``block``
    bytes of sets and sketches.

    A node is at home in its largest bucket, and moves to a larger home in reach, so that
    one group of alike nodes is not cut into as many homes as it has buckets. A component
    with many bytes there has blocks of its own and is one unit; each block of the others
    is a unit.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("members"))
    weight = classes.select(
        "node", (F.col("n_shingles") * 8 + F.octet_length("registers")).alias("weight")
    )
    homes = (
        buckets.join(sizes, "key")
        .groupBy("node", "component")
        .agg(F.max(F.struct("members", "key"))["key"].alias("home"))
        .join(weight, "node")
    )
    homes = stored(homes, "homes")
    for _ in range(_MOVES):
        homes = stored(_moved_in(buckets, homes), "homes")
    counts = homes.groupBy("home", "component").agg(F.sum("weight").alias("own"))
    rest = counts.groupBy("home").agg(
        F.sum(F.when(F.col("own") < block, F.col("own")).otherwise(0)).alias("rest")
    )
    large = F.col("own") >= block

    def part(count: str) -> Column:
        return F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / F.lit(block)))

    return (
        homes.join(counts, ["home", "component"])
        .join(rest, "home")
        .select(
            "node",
            "component",
            F.when(large, F.xxhash64("home", "component", part("own")))
            .otherwise(F.xxhash64("home", part("rest")))
            .alias("block"),
            large.alias("uniform"),
        )
        .withColumn(
            "unit",
            F.when(F.col("uniform"), F.xxhash64("component")).otherwise(F.col("block")),
        )
    )


def _moved_in(buckets: DataFrame, homes: DataFrame) -> DataFrame:
    """Every node in the largest home of all who share a bucket with it."""
    sizes = homes.groupBy("home").agg(F.sum("weight").alias("size"))
    near = (
        buckets.select("key", "node")
        .join(homes.join(sizes, "home"), "node")
        .groupBy("key")
        .agg(F.max(F.struct("size", "home")).alias("best"))
    )
    moved = (
        buckets.select("key", "node")
        .join(near, "key")
        .groupBy("node")
        .agg(F.max("best")["home"].alias("home"))
    )
    return homes.drop("home").join(moved, "node")


def _across(
    buckets: DataFrame,
    classes: DataFrame,
    sets: DataFrame,
    likeness: Likeness,
    block: int = BLOCK_BYTES,
) -> DataFrame:
    """Links between nodes that share a bucket but no component.

    Blocks of nodes meet, not single nodes: a set travels once per pair of blocks, and
    two blocks of one component never meet. A task compares the sketches of two blocks at
    once and the whole sets where the sketches leave a link possible.
    """
    nodes = stored(_blocks(buckets, classes, block), "blocks")
    in_bucket = (
        buckets.select("key", "node").join(nodes, "node").select("key", "unit", "uniform").distinct()
    )
    left, right = in_bucket.alias("l"), in_bucket.alias("r")
    units = (
        left.join(right, F.col("l.key") == F.col("r.key"))
        .where("l.unit < r.unit OR (l.unit = r.unit AND NOT l.uniform)")
        .select(F.col("l.unit").alias("unit"), F.col("r.unit").alias("other_unit"))
        .distinct()
    )
    of_unit = nodes.select("unit", "block").distinct()
    meetings = stored(
        units.join(of_unit, "unit")
        .join(of_unit.toDF("other_unit", "other_block"), "other_unit")
        .select("block", "other_block")
        .distinct()
        .withColumn("meeting", F.xxhash64("block", "other_block")),
        "meetings",
    )
    parts = max(1, meetings.count() // 2)
    sides = meetings.select("meeting", "block", F.lit(0).alias("side")).union(
        meetings.where("block <> other_block").select("meeting", "other_block", F.lit(1))
    )
    data = nodes.join(classes.select("node", "n_shingles", "registers"), "node").join(sets, "node")
    rows = sides.join(data, "block").select(
        F.pmod("meeting", F.lit(parts)).alias("part"),
        "meeting", "side", "node", "component", "n_shingles", "registers", "shingles",
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, own in frame.groupby("meeting"):
            one = own[own["side"] == 0]
            other = own[own["side"] == 1]
            found += _meet(likeness, one, other if len(other) else one)
        return pd.DataFrame(found, columns=["node", "other"], dtype=object)

    return rows.groupBy("part").applyInPandas(run, "node binary, other binary")


def _meet(likeness: Likeness, ones: pd.DataFrame, others: pd.DataFrame) -> list[tuple]:
    """Links between two blocks, over components."""
    registers = [
        np.frombuffer(b"".join(side["registers"]), "<u2").reshape(len(side), -1)
        for side in (ones, others)
    ]
    sizes = [side["n_shingles"].to_numpy(float) for side in (ones, others)]
    codes = pd.factorize(pd.concat([ones["component"], others["component"]]))[0]
    nodes = [side["node"].tolist() for side in (ones, others)]
    sets = [side["shingles"].tolist() for side in (ones, others)]
    links = []
    for stripe in range(0, len(ones), _STRIPE):
        own = slice(stripe, min(stripe + _STRIPE, len(ones)))
        fits = codes[own, None] != codes[None, len(ones) :]
        low = np.minimum(sizes[0][own, None], sizes[1][None, :])
        high = np.maximum(sizes[0][own, None], sizes[1][None, :])
        fits &= low * 100 >= high * likeness.percent
        if ones is others:
            fits = np.triu(fits, k=stripe)
        at, to = np.nonzero(fits)
        at += stripe
        for begin in range(0, len(at), 1000):
            i, j = at[begin : begin + 1000], to[begin : begin + 1000]
            likely = may_link(likeness, registers[0][i], registers[1][j], sizes[0][i], sizes[1][j])
            for one, other in zip(i[likely].tolist(), j[likely].tolist()):
                if _linked(likeness, sets[0][one], sets[1][other]):
                    links.append(tuple(sorted((nodes[0][one], nodes[1][other]))))
    return links


def _linked(likeness: Likeness, one: bytes, other: bytes) -> bool:
    """Whether two whole sets are alike enough."""
    both = np.concatenate((np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= likeness.percent * (len(both) - common)


def _relabelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their components; buckets that lie in one component are left out."""
    rows = buckets.drop("component").join(labels, "node", "left").select(
        "key", "node", "members", F.coalesce("component", "node").alias("component")
    )
    mixed = (
        rows.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("key")
    )
    return rows.join(mixed, "key")


def near_duplicates(
    documents: DataFrame,
    likeness: Likeness | None = None,
    leaders: int = 4,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Every document's set size and near-duplicate component.

    Returns ``id, text_key, n_shingles, component_id, kept``: a hash of the text, the least
    id that links reach, and whether it is the row's own. Texts without words (null, empty,
    white space) have no shingles and link with nothing. Repeated rows share a component
    and are kept or not together. A row with a null id cannot be named in a link: it has no
    component and is kept. Texts of any length are compared whole. Other columns are not
    read; an empty table gives no rows.
    """
    likeness = likeness or Likeness()
    sketched = stored(sketches(documents, likeness, id, text), "sketches")
    classes = stored(
        sketched.where("node IS NOT NULL AND id IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min("id").alias("id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("registers").alias("registers"),
            F.first("keys").alias("keys"),
        ),
        "classes",
    )
    buckets = stored(_bucket_members(classes), "buckets")
    shared = classes.join(buckets.select("node").distinct(), "node", "left_semi")
    sets = stored(_sets(documents, shared, likeness, id, text), "sets")

    rows, known = buckets.withColumn("component", F.col("node")), None
    for seeds in filter(None, (range(1), range(1, leaders))):
        # The first leader joins most of what is alike; the others see what is left.
        pairs = stored(_star(rows, seeds), "pairs")
        links = stored(_confirmed(_likely(pairs, classes, likeness), sets, likeness), "links")
        labels = components(links if known is None else known.union(links))
        # What the links join is known: one link of every node says it again.
        known = labels.where("node <> component").toDF("node", "other")
        # In a bucket of two, the one pair was among those.
        rows = stored(_relabelled(rows.where("members > 2"), labels), "mixed")
    more = _across(rows.drop("members"), classes, sets, likeness)
    labels = components(known.union(stored(more, "links")))

    least = (
        classes.join(labels, "node")
        .groupBy("component")
        .agg(F.min("id").alias("component_id"))
    )
    named = (
        classes.select("node", F.col("id").alias("class_id"))
        .join(labels, "node", "left")
        .join(least, "component", "left")
        .select("node", F.coalesce("component_id", "class_id").alias("component_id"))
    )
    own = F.coalesce("component_id", "id")
    return (
        sketched.select("id", "text_key", "n_shingles", "node")
        .join(named, "node", "left")
        .select(
            "id", "text_key", "n_shingles",
            F.when(F.col("id").isNotNull(), own).alias("component_id"),
        )
        .withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    )


def without_near_duplicates(
    documents: DataFrame,
    likeness: Likeness | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The rows of ``documents`` that stay, all columns as they are: one text per group.

    Rows of a dropped text go together; repeated rows of a kept one stay together.
    """
    dropped = (
        near_duplicates(documents, likeness, id=id, text=text)
        .where("NOT kept")
        .select("id", "text_key")
        .distinct()
    )
    same = (F.col(f"rows.{id}") == dropped["id"]) & (
        F.xxhash64(F.col(f"rows.{text}")) == dropped["text_key"]
    )
    return documents.alias("rows").join(dropped, same, "left_anti")
