"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every unit of a text (a line, or a sentence of one) is hashed to a wide vector, and the
vectors are summed lane by lane modulo a power of two. Sums do not depend on the order of
the units, and one unit can be put in or taken out without reading the rest. The first
lanes are long and tell texts apart; the others count, for every bit of the hash, how many
units have it set. From the differences of these counts follows about how many units two
texts do not share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Long lanes, modulo 2 ** 62.
WIDE = 4
WIDE_MASK = (1 << 62) - 1
#: Counters modulo 2 ** 20, three in a number with a spare bit each, 21 numbers per hash.
PLACES = (0, 21, 42)
COUNTER = (1 << 20) - 1
COUNTER_MASK = sum(COUNTER << place for place in PLACES)
BIT_MASK = sum(1 << place for place in PLACES)
NUMBERS = 21
HASHES = 2
#: Where units end, besides at the end of a line.
UNIT_END = r"(?<=[.!?|])\x20|\n"


def units(text: Column) -> Column:
    """The multiset of a text's units; an empty text has the empty unit."""
    return F.split(text, UNIT_END, -1)


def _sum(hashes: Column, lane, mask: int) -> Column:
    return F.aggregate(
        hashes,
        F.lit(0).cast("long"),
        lambda total, value: (total + lane(value)).bitwiseAND(F.lit(mask)),
    )


def with_vector(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the lanes of the fingerprint of ``text`` as an array of 64-bit numbers.

    Units and their hashes are columns of their own on the way, so that they are made once
    and not once a lane.
    """
    own, wide, bits = f"{name}_units", f"{name}_wide", f"{name}_bits"

    def hashes(seed: int) -> Column:
        return F.transform(own, lambda unit: F.xxhash64(unit, F.lit(seed)))

    def shifted(shift: int):
        return lambda value: F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(BIT_MASK))

    columns = rows.columns
    rows = rows.select("*", units(text).alias(own))
    rows = rows.select(
        *columns,
        F.size(own).cast("long").alias(own),
        *[hashes(seed).alias(f"{wide}{seed}") for seed in range(WIDE)],
        *[hashes(-1 - seed).alias(f"{bits}{seed}") for seed in range(HASHES)],
    )
    lanes = [
        _sum(F.col(f"{wide}{seed}"), lambda value: value.bitwiseAND(F.lit(WIDE_MASK)), WIDE_MASK)
        for seed in range(WIDE)
    ]
    for seed in range(HASHES):
        hashed = F.col(f"{bits}{seed}")
        lanes += [_sum(hashed, shifted(shift), COUNTER_MASK) for shift in range(NUMBERS)]
    return rows.select(*columns, F.array(*lanes, F.col(own)).alias(name))


def fingerprint(lanes: Column) -> Column:
    """A vector as text: 16 hexadecimal digits a lane."""
    return F.array_join(F.transform(lanes, lambda lane: F.lpad(F.lower(F.hex(lane)), 16, "0")), "")


def combined(one: Column, other: Column, sign: int = 1) -> Column:
    """The vector of both texts' units together; with sign -1, of the first without the
    second's."""
    count = WIDE + NUMBERS * HASHES
    masks = F.array(*[F.lit(WIDE_MASK)] * WIDE, *[F.lit(COUNTER_MASK)] * NUMBERS * HASHES)

    def both(place: Column) -> Column:
        mask = F.element_at(masks, place)
        right = F.element_at(other, place)
        if sign < 0:
            # Lanes are subtracted with a borrow of their own: one more than each mask.
            right = F.when(place <= WIDE, (mask - right + 1).bitwiseAND(mask)).otherwise(
                (mask - right).bitwiseAND(mask)
            )
            once = F.when(place <= WIDE, F.lit(0)).otherwise(F.lit(BIT_MASK))
            return ((F.element_at(one, place) + right).bitwiseAND(mask) + once).bitwiseAND(mask)
        return (F.element_at(one, place) + right).bitwiseAND(mask)

    lanes = F.transform(F.sequence(F.lit(1), F.lit(count)), both)
    units_of_both = F.element_at(one, count + 1) + sign * F.element_at(other, count + 1)
    return F.concat(lanes, F.array(units_of_both))


def likeness(one: Column, other: Column) -> Column:
    """About the share of units that two texts have in common, 0 to 1; equal vectors 1.

    A counter with its number of units gives the sum of random signs of the units; the mean
    square of such a sum is the number of units, for one text as for what two do not share.
    """
    first, last = WIDE + 1, WIDE + NUMBERS * HASHES

    def signed(lanes: Column) -> Column:
        """Twice each counter less the number of units."""
        size = F.element_at(lanes, last + 1)
        return F.flatten(
            F.transform(
                F.slice(lanes, first, last - first + 1),
                lambda lane: F.array(
                    *[
                        2 * F.shiftrightunsigned(lane, place).bitwiseAND(F.lit(COUNTER)) - size
                        for place in PLACES
                    ]
                ),
            )
        )

    def squares(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda total, value: total + value * value)

    mine, theirs = signed(one), signed(other)
    apart = squares(F.zip_with(mine, theirs, lambda a, b: (a - b).cast("double")))
    whole = squares(F.transform(mine, lambda a: a.cast("double"))) + squares(
        F.transform(theirs, lambda a: a.cast("double"))
    )
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / whole))
    return F.when(one == other, 1.0).when(whole == 0, 0.0).otherwise(share)


def fingerprints(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, lanes, fingerprint`` of every text.

    Null counts as empty; texts with the same units have the same fingerprint, equal texts
    among them. Repeated rows get equal results; texts are read whole; other columns are
    not read; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(id).alias("id"), whole.alias("text"))
    return with_vector(rows, F.col("text"), "lanes").select(
        "id", "lanes", fingerprint(F.col("lanes")).alias("fingerprint")
    )


# --- next documents --------------------------------------------------------------------


def next_ids(documents: DataFrame, id: str = "doc_id", parts: int = 4096) -> DataFrame:
    """``id, next_id``: distinct ids in ascending order, the last followed by the first.

    Ids are cut into ranges at quantiles and ordered within; only the ids move. A null id
    comes before all others.
    """
    ids = documents.select(F.col(id).alias("id")).distinct()
    cuts = ids.agg(F.percentile_approx("id", [k / parts for k in range(1, parts)], 100 * parts))
    bounds = sorted(set(cuts.first()[0] or []))
    every = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(bound) for bound in bounds[::every]]) if bounds else F.array()
    groups = F.array(
        F.array().cast("array<bigint>"),
        *[
            F.array(*[F.lit(bound) for bound in bounds[start : start + every]])
            for start in range(0, len(bounds), every)
        ],
    )
    group = F.size(F.filter(coarse, lambda bound: bound <= F.col("id")))
    fine = F.size(F.filter(F.element_at(groups, group + 1), lambda bound: bound <= F.col("id")))
    ranged = ids.withColumn("range", F.coalesce(group * (every + 1) + fine, F.lit(-1)))
    inside = Window.partitionBy("range").orderBy("id")
    following = ranged.withColumn("next_id", F.lead("id").over(inside)).withColumn(
        "last", F.row_number().over(Window.partitionBy("range").orderBy(F.desc("id"))) == 1
    )
    # The least id of every range: as many rows as ranges, which is bounded.
    starts = {
        row["range"]: row["least"]
        for row in ranged.groupBy("range").agg(F.min("id").alias("least")).collect()
    }
    order = sorted(starts)
    after = {r: starts[n] for r, n in zip(order, order[1:] + order[:1])}
    pairs = [(int(r), n) for r, n in after.items()]
    kind = documents.schema[id].dataType.simpleString()
    heads = documents.sparkSession.createDataFrame(pairs, f"range int, head {kind}")
    return following.join(F.broadcast(heads), "range").select(
        "id", F.when(F.col("last"), F.col("head")).otherwise(F.col("next_id")).alias("next_id")
    )


def compare_with_next(
    documents: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Fingerprints of every text, of its edit and of the next text, and their likeness.

    The edit replaces the last half of the code points (rounded down) by as many from the
    start of the next document, or all of it where that is shorter. Returns ``id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. Where an id
    repeats, the text with the least start stands for it as the next document.
    """
    order = next_ids(documents, id)
    texts = documents.select(
        F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # How much of its text the next document has to send.
    needs = (
        documents.select(
            F.col(id).alias("of_id"),
            F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 2).cast("int").alias("half"),
        )
        .groupBy("of_id")
        .agg(F.max("half").alias("need"))
        .join(order, F.col("of_id").eqNullSafe(order["id"]))
        .select("of_id", "next_id", "need")
    )
    given = texts.join(needs, F.col("id").eqNullSafe(F.col("next_id")))
    sent = (
        with_vector(given, F.col("text"), "lanes")
        .select(
            "of_id", F.struct(F.expr("substring(text, 1, need)").alias("head"), "lanes").alias("next")
        )
        .groupBy("of_id")
        .agg(F.min("next").alias("next"))
    )
    edited = F.concat(
        F.expr("substring(text, 1, int(length(text) - floor(length(text) / 2)))"),
        F.expr("substring(next.head, 1, int(floor(length(text) / 2)))"),
    )
    lanes = texts.join(sent, F.col("id").eqNullSafe(F.col("of_id"))).select(
        "id", "text", edited.alias("edited"), F.col("next.lanes").alias("next_lanes")
    )
    lanes = with_vector(lanes, F.col("text"), "lanes")
    lanes = with_vector(lanes, F.col("edited"), "edited_lanes")
    return lanes.select(
        "id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("lanes")).alias("fingerprint"),
        fingerprint(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
