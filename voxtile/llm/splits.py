"""Train, validation and test splits that keep related records together (problem 4).

Method: minimum labels are propagated over the bipartite graph of records and entities
until none changes; records with one label are a group. Groups are then assigned so that
the distribution of the segments' language in each split deviates little from the wanted
shares: units are placed one after another, largest first, each where the share of its
languages that is filled already is least.

Scale: edges are made distinct before the first shuffle, so a person with a third of all
rows is one edge per recording, and joins split keys of very many rows into parts. Each
round also jumps labels to their label's label, so the number of rounds grows with the
logarithm of the longest chain. A round is cut by a checkpoint in the shared folder. The
units that the driver places are groups above 1/1000 of the rows, fewer than 1,000 by
arithmetic, and for all others at most 256 hash cells for each language and size class
(powers of two), fewer than 130,000 rows whatever the corpus. Pairs of a group come block
by block.

Defined results: null recording ids take no part; labels that name nobody or only a role
link nothing; a recording without any named person is a group alone; a code that is no
language of the table counts as "?"; repeated rows and repeated deliveries count once;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtile.llm.people import label_key_udf, resolve
from voxtile.llm.turns import CODES
from voxtile.operators.dataset import with_position
from voxtile.operators.joins import block_pairs
from voxtile.session import SEGMENT_FIELDS, checkpointed, first_delivery, salted_join

LARGE = 1000
CELLS = 256
MAX_ROUNDS = 60


def segments(supervision: DataFrame) -> DataFrame:
    """(id, recording_id, speaker, language) of the delivery of each segment that counts."""
    return first_delivery(supervision, SEGMENT_FIELDS, ["recording_id", "speaker", "language"]).where("recording_id is not null")


def record_entities(supervision: DataFrame, speakers: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(record, entity): recordings and the persons that ``speaker`` names in them, once each."""
    chosen = segments(supervision) if chosen is None else chosen
    said = chosen.where("speaker is not null").select("recording_id", "speaker").distinct()
    said = said.select(F.col("recording_id").alias("record"), label_key_udf("speaker").alias("key")).where("key is not null and key not like 'role:%'").distinct()
    people = resolve(said.select("key"), speakers).select("key", F.col("person").alias("entity"))
    return salted_join(said, people, "key", "record").select("record", "entity").distinct()


def connected_groups(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(record, label): records joined by chains of shared entities have one label, the least record among them.

    Each round: an entity takes the least label of its records, a record the least label of
    its entities, then labels jump to the label of their label.
    """
    edges = checkpointed(edges.select("record", "entity"))
    labels = edges.select("record").distinct().select("record", F.col("record").alias("label"))
    labels = checkpointed(labels)
    for _ in range(max_rounds):
        least = salted_join(edges, labels, "record", "entity").groupBy("entity").agg(F.min("label").alias("label"))
        offered = salted_join(edges, least, "entity", "record").groupBy("record").agg(F.min("label").alias("offer"))
        stepped = labels.join(offered, "record").select("record", F.col("label").alias("old"), F.least("label", "offer").alias("label"))
        parents = stepped.select(F.col("record").alias("label"), F.col("label").alias("above"))
        jumped = salted_join(stepped, parents, "label", "record", "left").select("record", "old", F.least("label", F.coalesce("above", "label")).alias("label"))
        step = checkpointed(jumped)
        changed = step.where("label <> old").limit(1).count()
        labels = step.select("record", "label")
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def linked_pairs(groups: DataFrame, block: int = 1000) -> DataFrame:
    """(recording_a, recording_b), a < b: all pairs of one group."""
    often = groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("label")
    placed = with_position(salted_join(groups, often, "label", "record"), "label", "record")
    firsts = placed.groupBy("label").agg(F.min("_pos").alias("first"))
    placed = salted_join(placed, firsts, "label", "record").withColumn("place", F.col("_pos") - F.col("first"))
    pairs = block_pairs(placed, "label", "place", "record", block)
    return pairs.select(F.col("left").alias("recording_a"), F.col("right").alias("recording_b"))


def language_label(code: Column) -> Column:
    """The language of a code by the table of languages, "?" where it has none."""
    table = F.create_map(*[F.lit(x) for name, of in CODES.items() for x in (name, of)])
    return F.coalesce(F.try_element_at(table, F.split(F.lower(F.trim(code)), "[-_]")[0]), F.lit("?"))


def place_units(units: list[tuple[object, dict[str, float]]], shares: list[tuple[str, float]], totals: dict[str, float]) -> dict:
    """The split of each unit (name, rows by label): largest first, to the split where its labels are filled least against their shares."""
    filled = {s: {k: 0.0 for k in totals} for s, _ in shares}
    placed = {}
    for name, counts in sorted(units, key=lambda u: (-sum(u[1].values()), str(u[0]))):

        def fill(split: str, share: float) -> float:
            return sum(v * (filled[split][k] + v) / (share * totals[k]) for k, v in counts.items()) if share > 0 else float("inf")

        best = min(shares, key=lambda s: fill(*s))[0]
        placed[name] = best
        for k, v in counts.items():
            filled[best][k] += v
    return placed


def assign_splits(supervision: DataFrame, speakers: DataFrame, shares: dict[str, float], groups: DataFrame | None = None) -> DataFrame:
    """(id, recording_id, language, split): one split per segment, the same for all that share a recording or a person."""
    spark = supervision.sparkSession
    segs = checkpointed(segments(supervision))
    groups = connected_groups(record_entities(supervision, speakers, segs)) if groups is None else groups
    segs = segs.withColumn("language", language_label(F.col("language")))
    per = segs.groupBy("recording_id", "language").agg(F.count(F.lit(1)).alias("n"))
    per = salted_join(per, groups.withColumnRenamed("record", "recording_id"), "recording_id", "language", "left")
    per = checkpointed(per.withColumn("label", F.coalesce("label", "recording_id")))
    by_label = checkpointed(per.groupBy("label", "language").agg(F.sum("n").alias("n")))
    # one row for each language of the table
    totals = {r["language"]: float(r["n"]) for r in by_label.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    total = sum(totals.values())
    whole = by_label.groupBy("label").agg(F.sum("n").alias("size"), F.max_by("language", F.struct("n", "language")).alias("k"))
    whole = whole.withColumn("class", F.floor(F.log2("size"))).withColumn("cell", F.pmod(F.xxhash64("label"), F.lit(CELLS)))
    # fewer than LARGE groups can hold more than 1/LARGE of the rows each; the others share at most CELLS cells per language and class
    alone = F.col("size") * LARGE > total
    unit = F.when(alone, F.concat(F.lit("g/"), "label")).otherwise(F.concat_ws("/", F.lit("c"), "k", F.col("class").cast("string"), F.col("cell").cast("string")))
    of_group = checkpointed(whole.select("label", unit.alias("unit")))
    counted = by_label.join(of_group, "label").groupBy("unit", "language").agg(F.sum("n").alias("n"))
    units: dict[str, dict[str, float]] = {}
    for r in counted.collect():
        units.setdefault(r["unit"], {})[r["language"]] = float(r["n"])
    placed = place_units(list(units.items()), list(shares.items()), totals)
    chosen = spark.createDataFrame(list(placed.items()), "unit string, split string")
    # as many rows as units, fewer than 131,000
    of_group = of_group.join(F.broadcast(chosen), "unit").select("label", "split")
    of_record = salted_join(per.select("recording_id", "label").distinct(), of_group, "label", "recording_id").select("recording_id", "split")
    return salted_join(segs.select("id", "recording_id", "language"), of_record, "recording_id", "id").select("id", "recording_id", "language", "split")


def split_deviation(assigned: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(language, split, n, total, points): how far, in points of a hundred, each language's share in each split is from the wanted one."""
    wanted = assigned.sparkSession.createDataFrame(list(shares.items()), "split string, wanted double")
    counts = assigned.groupBy("language", "split").agg(F.count(F.lit(1)).alias("n"))
    every = counts.select("language").distinct().join(F.broadcast(wanted), how="cross")  # splits times languages of the table
    counts = every.join(counts, ["language", "split"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy("language")))
    return counts.select("language", "split", "n", "total", (100.0 * (F.col("n") / F.col("total") - F.col("wanted"))).alias("points"))


def split_shares(assigned: DataFrame) -> DataFrame:
    """(split, n, share) of an assignment."""
    counts = assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
