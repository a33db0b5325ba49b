"""Command line: the tasks that the operators make up.

    python -m corvane.cli list
    python -m corvane.cli run NAME --data DIR --out PATH
    python -m corvane.cli screen --manifest CSV --records JSON [JSON ...] --out DIR
    python -m corvane.cli label --manifest CSV --records JSON [JSON ...] [--seeds CSV] --out DIR
    python -m corvane.cli split --rows CSV --group COLUMN --stratum COLUMN --out DIR
    python -m corvane.cli score --predictions CSV --out DIR
    python -m corvane.cli counts|collect --client MODULE:NAME ...

Each task is a function of a session and its arguments that returns the frames that it
writes, by name, so that other code can call it.
"""

from __future__ import annotations

import argparse
import datetime
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.lexicon import classify
from corvane.functions.text import record_text
from corvane.operators import corpus, counts, labels, metrics, splits
from corvane.sources import files, report, search

Frames = dict[str, DataFrame]


def texts_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(acn, synopsis, narrative, all_text) of raw records, the last of each acn."""
    raw = corpus.last_wins(files.read_records(spark, paths), "acn", ["file_ord", "pos"])
    synopsis, narrative, every = record_text("synopsis", "people")
    return raw.select("acn", synopsis.alias("synopsis"), narrative.alias("narrative"), every.alias("all_text"))


def screen(spark: SparkSession, manifest: str, records: list[str]) -> Frames:
    """Every row of the manifest with its screening; rows without a record are uncertain."""
    texts = texts_of(spark, records).withColumn("found", F.lit(True))
    rows = files.read_csv(spark, manifest).join(texts, "acn", "left")
    rows = classify(rows.drop("screening_status"))
    found = F.col("found").isNotNull()
    rows = rows.withColumns({
        "screening_status": F.when(found, F.col("screening_status")).otherwise("uncertain_needs_review"),
        "primary_event_type": F.when(found, F.col("primary_event_type")).otherwise("not_relevant"),
        "exclusion_reason": F.when(found, F.col("exclusion_reason")).otherwise(labels.NOT_FOUND),
    })
    out = rows.select("candidate_id", "acn", "query_id", "screening_status", "primary_event_type", "secondary_event_types", "multi_event_flag", "ground_evidence", "cabin_evidence", "exclusion_reason")
    return {"screening": out, "status_counts": counts.frequency(out, "screening_status"), "type_counts": counts.frequency(out, "primary_event_type"), "query_counts": counts.multi_frequency(out, "query_id", name="query_id")}


def label(spark: SparkSession, manifest: str, records: list[str], labeler: str, date: str, status: str, notes: str, seeds: str | None = None) -> Frames:
    """The label table of a manifest; with seeds, of an expanded corpus."""
    rows, texts = files.read_csv(spark, manifest), texts_of(spark, records)
    if seeds is None:
        out = labels.silver_rows(rows.select("corpus_id", "candidate_id", "acn", "query_id"), texts, labeler, date, status, notes)
    else:
        out = labels.label_rows(rows, files.read_csv(spark, seeds), texts, labeler, date, status, notes)
    return {"labels": out, "status_counts": counts.frequency(out, "silver_screening_status"), "type_counts": counts.frequency(out, "silver_primary_event_type")}


def split(spark: SparkSession, rows: str, group: str, stratum: str, seed: int) -> Frames:
    """Rows with their split, the size of each, and groups that straddle splits."""
    out = splits.group_split(files.read_csv(spark, rows), group, stratum, seed)
    return {"splits": out, "split_counts": counts.frequency(out, "split", stratum), "leaks": splits.leaks(out, group)}


def score(spark: SparkSession, predictions: str) -> Frames:
    """Metrics of a prediction table by task, model and split, and its commonest errors."""
    by = ["task", "model", "split"]
    rows = files.read_csv(spark, predictions)
    scores = metrics.single_label(metrics.confusion(rows, "gold_label", "predicted_label", by), by)
    return {"metrics": scores, "best": corpus.best_per_group(scores, "task", "macro_f1", ["model", "split"]), "errors": counts.frequency(rows.filter("gold_label <> predicted_label"), *by, "gold_label", "predicted_label")}


def collect(spark: SparkSession, client, query_id: str, text: str, first_year: int, last_year: int, limit: int | None) -> Frames:
    """Records of one query in the year window, and their manifest."""
    records, listed = search.collect_query(spark, query_id, text, client.post, client.fetch, first_year, last_year, limit)
    return {"records": records, "manifest": listed}


def query_counts(spark: SparkSession, client, queries: dict[str, str], run_date: str, interface: str, window: str) -> Frames:
    return {"query_counts": search.query_counts(spark, client.post, queries, run_date, interface, window)}


def run(spark: SparkSession, name: str, data: str) -> Frames:
    """A registered query."""
    from corvane.plans import registry

    return {name: registry.queries()[name](spark, data)}


def write(spark: SparkSession, frames: Frames, out: str) -> None:
    """Frames as CSV folders, JSON where columns are nested, and a summary of the small ones."""
    for name, df in frames.items():
        if any(t.startswith(("array", "struct", "map")) for _, t in df.dtypes):
            df.write.mode("overwrite").json(f"{out}/{name}")
        else:
            files.write_csv(df, f"{out}/{name}", df.columns)
    small = {n: df for n, df in frames.items() if n.endswith("counts") or n in ("metrics", "best")}
    files.write_json_config(spark, {"summary": report.document("Summary", small)} if small else {}, f"{out}/summary.json")


def _client(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corvane", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(dest="command", required=True)
    today = datetime.date.today().isoformat()

    def command(name: str, *arguments: tuple[str, dict]) -> None:
        p = commands.add_parser(name)
        for flag, given in arguments:
            p.add_argument(flag, **given)
        if name != "list":
            p.add_argument("--out", required=True)

    need = {"required": True}
    many = {"required": True, "nargs": "+"}
    command("list")
    command("run", ("name", {}), ("--data", need))
    command("screen", ("--manifest", need), ("--records", many))
    command("label", ("--manifest", need), ("--records", many), ("--seeds", {}), ("--labeler", {"default": "rules"}), ("--date", {"default": today}), ("--status", {"default": "not_human_verified"}), ("--notes", {"default": ""}))
    command("split", ("--rows", need), ("--group", need), ("--stratum", need), ("--seed", {"type": int, "default": 20260603}))
    command("score", ("--predictions", need))
    command("collect", ("--client", need), ("--query-id", need), ("--text", need), ("--first-year", {"type": int, "default": 2011}), ("--last-year", {"type": int, "default": 2025}), ("--limit", {"type": int}))
    command("counts", ("--client", need), ("--queries", need), ("--run-date", {"default": today}), ("--interface", {"default": ""}), ("--window", {"default": ""}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Frames:
    given = vars(parser().parse_args(argv))
    command, out = given.pop("command"), given.pop("out", None)
    if command == "list":
        from corvane.plans import registry

        print("\n".join(registry.queries()))
        return {}
    spark = spark or SparkSession.builder.getOrCreate()
    if "client" in given:
        given["client"] = _client(given["client"])
    if "queries" in given:
        given["queries"] = json.loads(given["queries"])
    task: Callable[..., Frames] = {"counts": query_counts}.get(command) or globals()[command]
    frames = task(spark, **given)
    write(spark, frames, out)
    return frames


if __name__ == "__main__":
    main()
