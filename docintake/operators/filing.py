"""File plans: actions, destinations, dry run, audit rows, outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Automation
from ..functions.naming import Lookup, from_map, resolve_dest_folder, resolve_pattern
from ..functions.text import file_name, suffix
from .collisions import resolve_collision

OUTPUT = "array<struct<kind:string,folder:string,name:string>>"


def apply_actions(docs: DataFrame, automations: list[Automation], base: str, fields: str = "fields") -> DataFrame:
    """docs(automation_id, fields, default_folder, default_name) with `blocked`, `has_move` and `outputs`.

    Copies come first, in order, each with the name of its moment; then the move or rename of the document itself,
    unless there are only copies. A name or folder that cannot be resolved blocks the document: no outputs at all.
    """
    look, made = from_map(F.col(fields)), {}
    plan = F.lit(None).cast(f"struct<blocked:boolean,has_move:boolean,outputs:{OUTPUT}>")
    for i, a in enumerate(automations):
        own, resolved = F.col("automation_id") == a.automation_id, {}
        plan = F.when(own, _folded(a, look, base, f"__made_{i}_", resolved)).otherwise(plan)
        made |= {n: F.when(own, c) for n, c in resolved.items()}
    absent = {"blocked": F.lit(False), "has_move": F.lit(False), "outputs": F.array().cast(OUTPUT)}
    # names and folders are columns of their own, so that each is worked out once and by compiled code
    out = docs.withColumns(made).withColumn("__plan", plan)
    return out.withColumns({n: F.coalesce(F.col(f"__plan.{n}"), c) for n, c in absent.items()}).drop("__plan", *made)


def _folded(a: Automation, look: Lookup, base: str, prefix: str, resolved: dict[str, Column]) -> Column:
    """struct(blocked, has_move, outputs) of one automation, over the columns of names and folders that it adds to `resolved`."""
    folder, name, copies, moved = "default_folder", "default_name", [], False
    for action in sorted(a.actions, key=lambda x: x.position):
        made = f"{prefix}{len(resolved)}"
        if action.action_type == "rename":
            resolved[made] = resolve_pattern(action.params.get("name_pattern", ""), look)
            name = made
        elif action.action_type in ("move", "copy"):
            resolved[made] = resolve_dest_folder(action.params.get("dest_folder", ""), look, base)
            if action.action_type == "move":
                folder, moved = made, True
            else:
                copies.append(("copy", made, name))
    wanted = [*copies, ("move", folder, name)] if moved or not copies else copies
    blocked = F.lit(False)
    for n in resolved:
        blocked = blocked | F.col(n).isNull()
    outputs = F.array(*[_output(kind, F.col(f), F.col(n)) for kind, f, n in wanted]).cast(OUTPUT)
    outputs = F.when(blocked, F.array().cast(OUTPUT)).otherwise(outputs)
    return F.struct(blocked.alias("blocked"), F.lit(moved).alias("has_move"), outputs.alias("outputs"))


def _output(kind: str, folder: Column, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), folder.alias("folder"), name.alias("name"))


def plan_dest(source: Column, folder: Column, name: Column) -> Column:
    """folder/name; a name without a real extension (one that starts with a letter) gets that of the source."""
    own = file_name(source)
    w, n = F.coalesce(folder, F.regexp_replace(source, "/[^/]*$", "")), F.coalesce(name, own)
    where = F.concat(F.regexp_replace(w, r"[/\\]+$", ""), F.when(w.rlike(r"^[A-Za-z]:|^\\\\"), F.lit("\\")).otherwise(F.lit("/")))
    return F.concat(where, F.when(suffix(n).rlike(r"^\.\p{L}"), n).otherwise(F.concat(n, suffix(own))))


def source_path(docs: DataFrame, originals: DataFrame, folders: DataFrame) -> DataFrame:
    """Docs with `source`: the original of the same content, else the original by id, else the own file name."""
    place = originals.join(folders.select("folder_id", F.col("path").alias("folder")), "folder_id", "left").select(
        "hash", "origin_id", F.concat_ws("/", "folder", "filename").alias("place")
    )
    by_hash = place.groupBy("hash").agg(F.min_by("place", "origin_id").alias("by_hash"))
    by_id = place.select("origin_id", F.col("place").alias("by_id"))
    j = docs.join(by_hash, docs.content_hash == by_hash.hash, "left").drop("hash").join(by_id, "origin_id", "left")
    return j.withColumn("source", F.coalesce("by_hash", "by_id", "filename")).drop("by_hash", "by_id")


def planned_outputs(docs: DataFrame) -> DataFrame:
    """One row per output of P1: document_id, position, kind, dest, hash; docs has source and content_hash.

    array_compact keeps all outputs; it is there so that no filter on `outputs` works the names out a second time.
    """
    rows = docs.select("document_id", "source", "content_hash", F.posexplode(F.array_compact("outputs")).alias("position", "o"))
    return rows.select("document_id", "position", F.col("o.kind").alias("kind"), plan_dest(F.col("source"), F.col("o.folder"), F.col("o.name")).alias("dest"), F.col("content_hash").alias("hash"), "source")


def dry_run(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row for a blocked or unmatched document, else one per output, held against the manifest only.

    An output for which no number is free is an `error`.
    """
    rows = docs.select("document_id", "automation_id", "blocked", "source", F.col("content_hash").alias("hash"), F.posexplode_outer(F.array_compact("outputs")).alias("position", "o"))
    dest = F.when(F.col("o").isNotNull(), plan_dest(F.col("source"), F.col("o.folder"), F.col("o.name")))
    outputs = resolve_collision(rows.withColumns({"kind": F.col("o.kind"), "dest": dest}), manifest)
    idle = F.when(F.col("automation_id").isNull(), "no_match").when(F.col("blocked"), "blocked")
    done = F.when(F.col("identical"), "skipped").when(F.col("final").isNull(), "error").otherwise("applicable")
    status = F.when(F.col("o").isNull(), idle).otherwise(done)
    return outputs.select("document_id", status.alias("status"), "position", "kind", "dest", "final").where("status is not null")


def dry_run_summary(rows: DataFrame) -> DataFrame:
    """P7"""
    return rows.agg(
        F.countDistinct(F.when(F.col("status") == "applicable", F.col("document_id"))).alias("ready"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "no_match").alias("no_match"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
    )


def ready_documents(docs: DataFrame) -> DataFrame:
    """P8"""
    return docs.where("state = 'processando' and step = 'classificado'")


def anchor(path: Column) -> Column:
    """The drive, share or root of an absolute path, null for a relative one."""
    windows = F.regexp_extract(path, r"^([A-Za-z]:|\\\\[^\\]+\\[^\\]+)", 1)
    posix = F.regexp_extract(path, r"^(/[^/]+)", 1)
    return F.when(windows != "", windows).when(posix != "", posix)


def anchor_missing(outputs: DataFrame, roots: DataFrame) -> DataFrame:
    """Outputs with `anchor_blocked`: some output of the document has an anchor that is not among roots(root)."""
    marked = outputs.withColumn("root", anchor(F.col("dest")))
    bad = marked.where("root is not null").join(roots.select("root"), "root", "left_anti").select("document_id").distinct().withColumn("bad", F.lit(True))
    return marked.join(bad, "document_id", "left").withColumn("anchor_blocked", F.coalesce("bad", F.lit(False))).drop("bad", "root")


def audit_rows(resolved: DataFrame, run_id: str) -> DataFrame:
    """P10: audit rows of resolved outputs. An identical copy is noted as done where it stands, an identical move leaves
    no row, and an output for which no number is free is an error: nothing is written over what is there."""
    rows = resolved.where((F.col("kind") == "copy") | ~F.col("identical"))
    failed = ~F.col("identical") & F.col("final").isNull()
    return rows.select(
        "document_id", F.when(F.col("kind") == "copy", "copy").otherwise("apply").alias("action"), F.when(failed, "error").otherwise("done").alias("status"),
        F.col("source").alias("source_path"), F.coalesce("final", "dest").alias("dest_path"), F.lit(run_id).alias("run_id"), F.col("hash").alias("content_hash"),
    )


def apply_outcome(docs: DataFrame, done: DataFrame) -> DataFrame:
    """Docs with state and step after the run; documents with a done audit row stay as they are."""
    already = done.where("status = 'done'").select("document_id").distinct().withColumn("already", F.lit(True))
    j = docs.join(already, "document_id", "left")
    acts = ~F.coalesce("already", F.lit(False)) & F.col("automation_id").isNotNull()
    review = acts & F.col("blocked") & (F.col("state") == "processando")
    applied = acts & ~F.col("blocked") & F.col("state").isin("processando", "em_revisao")
    return j.withColumns({"step": F.when(applied, "aplicado").otherwise(F.col("step")), "state": F.when(review, "em_revisao").when(applied, "concluido").otherwise(F.col("state"))}).drop("already")
