"""States of documents and the work lists that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STATES, TRANSITIONS
from ..sources.files import staged
from .audit import without_splits


def allowed(current: Column, wanted: Column) -> Column:
    """L1 as an expression."""
    out = F.lit(False)
    for state, targets in TRANSITIONS.items():
        out = F.when(current == state, wanted.isin(*targets)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def valid_transition(changes: DataFrame) -> DataFrame:
    """L1: changes(from_state, to_state) with `valid`."""
    return changes.withColumn("valid", allowed(F.col("from_state"), F.col("to_state")))


def replay_states(log: DataFrame, initial: str = "recebido", piece: str = "day") -> DataFrame:
    """L2: log(document_id, ts, id, to_state, step) folded in order; a request that is not allowed changes nothing.

    The log of a document is folded piece by piece (requests of one `piece` of time), each piece from every state that
    could stand before it; the pieces of a document are then put together, so that a long log is many small tasks.
    """
    return joined_replays(replay_pieces(log.withColumn("piece", F.date_trunc(piece, F.col("ts").cast("timestamp"))), initial=initial), initial)


def _known(initial: str) -> list[str]:
    return list(dict.fromkeys((*STATES, initial)))


def replay_pieces(log: DataFrame, *also: str, initial: str = "recebido") -> DataFrame:
    """document_id, piece (and what goes with them), ends: where the requests of the piece lead from each state, by its number.

    A request carries its own number and, as bits, the states that it is allowed from: one shift for each state and request.
    """
    states = _known(initial)
    code, sources = F.lit(-1), F.lit(0)
    for k, state in enumerate(states):
        bits = sum(1 << states.index(s) for s, targets in TRANSITIONS.items() if state in targets)
        code, sources = F.when(F.col("to_state") == state, k).otherwise(code), F.when(F.col("to_state") == state, bits).otherwise(sources)

    def request(acc: Column, x: Column) -> Column:
        ok = F.call_function("shiftright", x["sources"], acc["state"]).bitwiseAND(1) == 1
        return F.struct(
            F.when(ok, x["code"]).otherwise(acc["state"]).alias("state"),
            F.when(ok, F.coalesce(x["step"], acc["step"])).otherwise(acc["step"]).alias("step"),
            (acc["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"),
        )

    start = F.array(*[F.struct(F.lit(k).alias("state"), F.lit(None).cast("string").alias("step"), F.lit(0).cast("long").alias("rejected")) for k in range(len(states))])
    ordered = F.sort_array(F.collect_list(F.struct("ts", "id", "to_state", "step", code.alias("code"), sources.alias("sources"))))
    ends = F.aggregate(ordered, start, lambda acc, x: F.transform(acc, lambda a: request(a, x)))
    return log.groupBy("document_id", "piece", *also).agg(ends.alias("ends"))


def joined_replays(pieces: DataFrame, initial: str = "recebido") -> DataFrame:
    """document_id, state, step, rejected: the pieces of each document one after another from `initial` on."""
    states = _known(initial)

    def follow(acc: Column, x: Column) -> Column:
        came = F.get(x["ends"], acc["state"])
        return F.struct(came["state"].alias("state"), F.coalesce(came["step"], acc["step"]).alias("step"), (acc["rejected"] + came["rejected"]).alias("rejected"))

    start = F.struct(F.lit(states.index(initial)).alias("state"), F.lit(None).cast("string").alias("step"), F.lit(0).cast("long").alias("rejected"))
    whole = F.aggregate(F.sort_array(F.collect_list(F.struct("piece", "ends"))), start, follow)
    name = F.get(F.array(*map(F.lit, states)), F.col("s.state"))
    return pieces.groupBy("document_id").agg(whole.alias("s")).select("document_id", name.alias("state"), "s.step", "s.rejected")


def pending_extractions(docs: DataFrame, extractions: DataFrame) -> DataFrame:
    """L3"""
    return docs.where("state = 'processando' and step = 'aguardando_extracao'").join(extractions.select("document_id"), "document_id", "left_anti")


def pending_classifications(docs: DataFrame, results: DataFrame) -> DataFrame:
    """L4"""
    return docs.where("state = 'processando' and step = 'extraido'").join(results.select("document_id"), "document_id", "left_anti")


def pending_applications(docs: DataFrame, results: DataFrame, audit: DataFrame, threshold: float = 0.8, approval_mode: bool = False) -> DataFrame:
    """Nothing while a person approves; else classified documents with a sufficient score and no real done row."""
    ready = docs.where("state = 'processando' and step = 'classificado'").where(F.lit(not approval_mode))
    scored = ready.join(results.where(F.col("score") >= threshold).select("document_id"), "document_id", "left_semi")
    done = without_splits(audit).where("status = 'done'").select("document_id")
    return scored.join(done, "document_id", "left_anti")


def dead_letters(jobs: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of documents that exhausted jobs send to falha; docs(document_id, state, origin_hash, content_hash)."""
    dead = jobs.where("status = 'failed' or attempts >= max_attempts")
    by_origin = docs.join(dead.where("step = 'ingest'").select(F.col("hash").alias("origin_hash")), "origin_hash", "left_semi")
    by_block = docs.join(dead.where("step <> 'ingest'").select(F.col("hash").alias("content_hash")), "content_hash", "left_semi")
    both = by_origin.select("document_id", "state").unionByName(by_block.select("document_id", "state")).distinct()
    return both.where(allowed(F.col("state"), F.lit("falha"))).select("document_id")


def retry_step(docs: DataFrame) -> DataFrame:
    """L10"""
    return docs.where("state = 'falha'").select("document_id", F.when(F.col("step") == "extraido", "classify").otherwise("extract").alias("next_step"))


def reprocess_batch(docs: DataFrame, results: DataFrame, bucket: str | None = None, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents put back to processando for classification, results that remain); exactly one selector."""
    if (bucket is None) == (ids is None):
        raise ValueError("give a bucket or ids")
    chosen = docs.where(F.col("state").isin("quarentena", "em_revisao"))
    chosen = chosen.where(F.col("state") == bucket) if bucket is not None else chosen.join(ids.select("document_id").distinct(), "document_id", "left_semi")
    again = chosen.withColumns({"state": F.lit("processando"), "next_step": F.lit("classify")})
    return again, results.join(chosen.select("document_id"), "document_id", "left_anti")


def reclassify(docs: DataFrame, assignments: DataFrame, template_ids: DataFrame) -> DataFrame:
    """Quarantined documents with a known assigned template, back to processando with it forced."""
    known = assignments.select("document_id", "template_id").join(template_ids.select("template_id").distinct(), "template_id")
    quarantined = docs.where("state = 'quarentena'").select("document_id")
    return quarantined.join(known, "document_id").select("document_id", F.lit("processando").alias("state"), F.col("template_id").alias("forced_template"))


def delete_documents(ids: DataFrame, docs: DataFrame, originals: DataFrame, jobs: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What remains of every table: documents, originals, jobs and the child tables.

    Unknown ids are ignored. Jobs of a deleted content go; an original without blocks goes with its jobs.

    What goes is worked out once. Tables are held against hash tables of what goes, so that no task sorts its part of
    a table: it holds its part of the keys that go and lets the rows pass.
    """
    gone = staged(_held_against(docs, ids, "document_id", "left_semi").select("document_id", "origin_id", "content_hash"))
    left = _held_against(docs, gone, "document_id", "left_anti")
    emptied = staged(_held_against(gone.select("origin_id").distinct(), left.select("origin_id").distinct(), "origin_id", "left_anti"))
    lost = _held_against(originals, emptied, "origin_id", "left_semi")
    hashes = gone.select(F.col("content_hash").alias("hash")).unionByName(lost.select("hash"))
    out = {"documents": left, "originals": _held_against(originals, emptied, "origin_id", "left_anti"), "jobs": _held_against(jobs, hashes, "hash", "left_anti")}
    return out | {name: _held_against(t, gone, "document_id", "left_anti") for name, t in children.items()}


def _held_against(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A semi or anti join by a hash table of the keys; repeated keys take no room in it."""
    return rows.join(keys.select(key).hint("shuffle_hash"), key, how)
