"""Collisions of destination names: what is there already (P4), and outputs that follow one another (P5)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from ..functions.text import file_name, stem, suffix
from ..sources.files import staged

#: Fixed limit of numbered siblings.
MOST_SUFFIXES = 10_000
#: Slices in which the contents for one destination are ranked before they meet.
SLICES = 64
#: What a row of a played destination says: a place is held, a place is claimed from some time on, a content wants in.
HELD, CLAIM, WANTS = 0, 1, 2


def split_numbered(path: Column) -> tuple[Column, Column]:
    """(path without a trailing _i of its stem, i or null); i is a positive number without leading zeros."""
    name = file_name(path)
    head = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    i = F.regexp_extract(stem(name), r"(?s)^.+_([1-9]\d{0,4})$", 1)
    base = F.concat(head, F.regexp_replace(stem(name), r"_[1-9]\d{0,4}$", ""), suffix(name))
    return F.when(i != "", base), F.when(i != "", i.cast("int"))


def numbered(path: Column, i: Column) -> Column:
    name = file_name(path)
    head = F.substr(path, F.lit(1), F.length(path) - F.length(name))
    return F.when(i == 0, path).otherwise(F.concat(head, stem(name), F.lit("_"), i.cast("string"), suffix(name)))


def depth(path: Column) -> Column:
    """How many numbers stand at the end of the stem; a name is pushed to names one deeper."""
    tail = F.regexp_extract(stem(file_name(path)), r"((?:_[1-9]\d{0,4})+)$", 1)
    return F.length(tail) - F.length(F.replace(tail, F.lit("_"), F.lit("")))


def _siblings(manifest: DataFrame, most: int) -> DataFrame:
    """(dest, i, hash): who holds number i (0: the plain name) of each destination that has a numbered or plain holder."""
    base, i = split_numbered(F.col("path"))
    both = F.array(F.struct(F.col("path").alias("dest"), F.lit(0).alias("i")), F.struct(base.alias("dest"), i.alias("i")))
    rows = manifest.select("hash", F.explode(both).alias("at")).where(F.col("at.i") <= most)
    return rows.groupBy("at.dest", "at.i").agg(F.min("hash").alias("hash"))


def resolve_collision(plans: DataFrame, manifest: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """plans(dest, hash) with `identical` and `final`: dest if it is free; null and identical if it or a sibling
    before the first gap has this content; else the first free numbered sibling; null if all numbers are taken.

    The gap and the contents before it are worked out once for each destination. A null hash is like no content.
    """
    held = _siblings(manifest, most)
    place = F.row_number().over(Window.partitionBy("dest").orderBy("i")) - 1
    run = held.withColumn("place", place).where("i = place")
    free = run.groupBy("dest").agg(F.count("*").alias("free"))
    same = run.select("dest", "hash").where("hash is not null").distinct().withColumn("identical", F.lit(True))
    j = plans.join(free, "dest", "left").join(same, ["dest", "hash"], "left")
    gap, identical = F.coalesce("free", F.lit(0)), F.coalesce("identical", F.lit(False))
    final = F.when(~F.col("identical") & (gap <= most), numbered(F.col("dest"), gap))
    return j.withColumn("identical", identical).withColumn("final", final).drop("free")


def resolve_batch(plans: DataFrame, manifest: DataFrame, most: int = MOST_SUFFIXES) -> DataFrame:
    """P5: plans(document_id, position, dest, hash) one after another, each output occupying its place for the next ones.

    Adds `identical` and `final` as P4 does; both are false and null for an output that finds no free number. A null
    hash is a content of its own.

    Only contested destinations are played through: those that several contents want, those that something holds, and
    those onto which another output is pushed. All others are final at once. A path is reached as a destination of its
    own or by a number from the one name it extends (a_1.pdf from a.pdf), so a destination can be played by itself once
    three things are known: what holds it and its numbers, when somebody first claims each of its numbers as a
    destination of their own (from then on the place is taken, whoever has it), and what the name that it extends has pushed
    onto it. The first two are joins; for the third, shorter names are played before the ones they push to, one
    round for each depth of numbers that is contested. A destination gives a task at most `most` + 1 rows of each
    kind, as later contents cannot get a number: they can only be identical to what holds one.
    """
    at = F.struct("document_id", "position")
    own = F.concat_ws("/", F.lit("?"), F.col("document_id").cast("string"), F.col("position").cast("string"))
    named = plans.withColumn("content", F.coalesce(F.concat(F.lit("="), F.col("hash")), own))
    firsts = staged(named.groupBy("dest", "content").agg(F.min(at).alias("at")))
    wanted = firsts.groupBy("dest").agg(F.count("*").alias("contents"), F.min_by("content", "at").alias("content"), F.min("at").alias("at"))
    base, i = split_numbered(F.col("dest"))
    claims = wanted.select(base.alias("dest"), i.alias("i"), "at", "content").where(F.col("i") <= most)
    held = _siblings(manifest, most).select("dest", "i", F.concat(F.lit("="), "hash").alias("content"))
    several = wanted.where("contents > 1").select("dest")
    contested = several.unionByName(wanted.join(held.where("i = 0"), "dest", "left_semi").select("dest")).distinct()
    contested = staged(contested.withColumn("depth", depth(F.col("dest"))))

    rounds = {r[0] for r in contested.select("depth").distinct().collect()}
    pushed, results = None, []
    while rounds:
        rounds.remove(now := min(rounds))
        playing = contested.where(F.col("depth") == now).select("dest")
        taken = held
        if pushed is not None:
            playing = playing.unionByName(pushed.select("dest")).distinct()
            taken = held.unionByName(pushed)
        played = staged(_played(playing, _early(firsts, playing, most + 1), taken, claims, most))
        results.append(played)
        away = played.where("number > 0").select(numbered(F.col("dest"), F.col("number")).alias("dest"), F.lit(0).alias("i"), "content")
        pushed = staged(away.join(wanted.select("dest"), "dest", "left_semi"))
        if pushed.isEmpty():
            pushed = None
        else:
            rounds.add(now + 1)

    facts = firsts
    if results:
        played = results[0]
        for more in results[1:]:
            played = played.unionByName(more)
        known = played.where("not full").select("dest", "content", "number", "same")
        full = played.where("full").select("dest", "content").distinct().withColumn("there", F.lit(True))
        late = full.select("dest").distinct().withColumn("late", F.lit(True))
        facts = firsts.join(known, ["dest", "content"], "left").join(full, ["dest", "content"], "left").join(late, "dest", "left")
    else:
        facts = firsts.select("*", *[F.lit(None).cast(k).alias(n) for n, k in (("number", "int"), ("same", "boolean"), ("there", "boolean"), ("late", "boolean"))])
    quiet = F.col("same").isNull() & F.col("late").isNull()
    place = F.when(quiet, F.col("dest")).when(F.col("number").isNotNull(), numbered(F.col("dest"), F.col("number")))
    facts = facts.select("dest", "content", "at", place.alias("final"), F.coalesce("same", "there", F.lit(False)).alias("same"))
    out = named.join(facts, ["dest", "content"])
    first = F.col("at") == at
    identical = F.when(first, F.col("same")).otherwise(F.col("same") | F.col("final").isNotNull())
    return out.withColumns({"identical": identical, "final": F.when(first, F.col("final"))}).drop("at", "same", "content")


def _early(firsts: DataFrame, playing: DataFrame, room: int) -> DataFrame:
    """The first `room` contents of each destination that is played, ranked in slices before they meet."""
    rows = firsts.join(playing, "dest", "left_semi").withColumn("slice", F.pmod(F.xxhash64("content"), F.lit(SLICES)))
    for keys in (("dest", "slice"), ("dest",)):
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("k") <= room)
    return rows.select("dest", "at", "content")


def _played(playing: DataFrame, wants: DataFrame, held: DataFrame, claims: DataFrame, most: int) -> DataFrame:
    """(dest, content, number, same, full): the number that each content gets, or whether it is there already; for a
    destination without a free number also the contents of all its places (full)."""
    none = F.lit(None).cast(wants.schema["at"].dataType)
    rows = [
        held.join(playing, "dest", "left_semi").select("dest", F.lit(HELD).alias("kind"), "i", none.alias("at"), "content"),
        claims.join(playing, "dest", "left_semi").select("dest", F.lit(CLAIM).alias("kind"), "i", "at", "content"),
        wants.select("dest", F.lit(WANTS).alias("kind"), F.lit(None).cast("int").alias("i"), "at", "content"),
    ]
    rows = rows[0].unionByName(rows[1]).unionByName(rows[2]).select("dest", "kind", "i", "at.document_id", "at.position", "content")
    schema = StructType().add("dest", StringType()).add("content", StringType()).add("number", IntegerType()).add("same", BooleanType()).add("full", BooleanType())
    order = ["dest", "kind", "document_id", "position"]
    return rows.repartition("dest").sortWithinPartitions(*order).mapInArrow(partial(_walk, most=most), schema)


RESULT = pa.schema([("dest", pa.string()), ("content", pa.string()), ("number", pa.int32()), ("same", pa.bool_()), ("full", pa.bool_())])


def _walk(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Plays the destinations of one task, whose rows come in order; only one destination is in memory at a time."""
    way = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, RESULT, strict=True)], schema=RESULT)

    for batch in batches:
        rows = []
        for dest, kind, i, document, position, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if way is None or way.dest != dest:
                rows += way.contents() if way else ()
                way = _Way(dest, most)
            when = (document is not None, document, position is not None, position)  # nulls first, as Spark has it
            if kind == HELD:
                way.holds[i] = content
            elif kind == CLAIM:
                way.claims[i] = (when, content)
            else:
                rows.append((dest, content, *way.take(when, content), False))
        yield packed(rows)
    if way:
        yield packed(list(way.contents()))


class _Way:
    """The places of one destination, the plain name and its numbers, as far as they are known to be taken."""

    def __init__(self, dest: str, most: int) -> None:
        self.dest, self.most, self.next = dest, most, 0
        self.holds: dict[int, str | None] = {}
        self.claims: dict[int, tuple[tuple, str]] = {}
        self.seen: set[str | None] = set()
        self.last: tuple | None = None

    def advance(self, when: tuple) -> None:
        """Passes the places that are taken at that time; what stands in them is seen."""
        while self.next <= self.most:
            claim = self.claims.get(self.next)
            if self.next in self.holds:
                self.seen.add(self.holds[self.next])
            elif claim and claim[0] < when:
                self.seen.add(claim[1])
            else:
                break
            self.next += 1

    def take(self, when: tuple, content: str) -> tuple[int | None, bool]:
        """(the number that the content gets, whether it is there already)."""
        self.last = when
        self.advance(when)
        if content in self.seen:
            return None, True
        if self.next > self.most:
            return None, False
        self.holds[self.next] = content
        return self.next, False

    def contents(self) -> Iterator[tuple]:
        """What stands in the places, if all of them are taken after the last content."""
        if self.last:
            self.advance(self.last)
        if self.next > self.most:
            for content in self.seen:
                if content is not None:
                    yield self.dest, content, None, True, True
