"""Complete runs: mapping a query file, compiling a taxonomy."""

import json
import logging
from datetime import datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import output_order
from ..operators.lookup import from_taxonomy
from ..operators.report import (
    dedup_audit, detail_records, flow_links, outcome_counts, status_summary, status_table,
)
from ..operators.rows import band_breakdown, filtering_totals
from ..operators.taxonomy import compile_taxonomy, taxonomy_stats
from ..sources.dump import load_lookup, read_dump, resolve_dump, save_lookup
from ..sources.files import kind_of, total_bytes, write_text
from ..sources.sinks import export_lookup, run_folders, write_csv, write_report
from ..sources.tables import read_catalogue, read_queries
from .html import html_lines, write_html
from .mapping import MATCH_COLUMNS, map_names

log = logging.getLogger(__name__)


def map_file(
    spark: SparkSession, source: str, models: str, lookup: str, output: str = "./output",
    name: str = "", report: bool = False, plots: bool = False,
) -> str:
    """Map the names of a CSV file and write the run folder; returns the folder.

    All paths may lie on any file system that Spark reads and writes.
    """
    if not kind_of(spark, source):
        raise FileNotFoundError(source)
    job_id, folder = run_folders(spark, output, name)
    debug, results = f"{folder}/debug", f"{folder}/results"
    run = map_names(read_queries(spark, source), read_catalogue(spark, models), load_lookup(spark, lookup)).texts()
    rescued = run.final.where("bands <> 'auto-accept'")
    order = output_order()

    write_csv(run.inputs, f"{debug}/00_input.csv", ["pos"], ["taxa_name", "taxon"])
    write_csv(run.matched, f"{debug}/01_jaccard_raw.csv", order, MATCH_COLUMNS)
    write_json(spark, f"{debug}/02_filtering_stats.json", filtering_stats(run.matched))
    if not run.candidates.isEmpty():
        write_csv(run.candidates, f"{debug}/02_rescue_candidates.csv", order, MATCH_COLUMNS)
        rescued = run.rescued
        write_csv(rescued, f"{debug}/03_rescue_process.csv", order)
        log.info("outcomes: %s", {r["final_band"]: r["n"] for r in outcome_counts(rescued).collect()})
    write_csv(run.final, f"{results}/final_mapping.csv", order)
    write_report(
        run.items, job_id, order, f"{results}/mapping_report.json", datetime.now().isoformat()
    )
    for row in status_summary(run.items).orderBy("place").collect():
        log.info("%-15s %6d (%5.1f%%) %s", row["name"], row["n"], row["pct"], "█" * row["bar"])
    if plots:
        write_csv(flow_links(run.final), f"{folder}/plots/flow_links.csv", ["source", "target"])
    if report:
        details = detail_records(run.matched, rescued, run.items)
        lines = html_lines(
            job_id, filtering_totals(run.matched), band_breakdown(run.matched),
            status_table(run.items), dedup_audit(run.inputs, run.matched), details, order,
        )
        write_html(lines, f"{folder}/debug_report.html")
    return folder


def filtering_stats(matched) -> dict:
    stats = filtering_totals(matched).first().asDict()
    rows = band_breakdown(matched).orderBy(F.desc("n")).collect()
    return {**stats, "breakdown": {r["bands"]: r["n"] for r in rows}}


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    write_text(spark, path, json.dumps(value, indent=2))


def compile_dump(
    spark: SparkSession, dump: str, output: str, roots=None, work_dir=None, as_json: bool = False
) -> dict:
    """Compile a taxonomy dump into a stored lookup; returns its statistics."""
    folder = resolve_dump(spark, dump, work_dir)
    parts = [read_dump(spark, f"{folder}/{f}") for f in ("nodes.dmp", "names.dmp", "merged.dmp")]
    records, keys, scope = compile_taxonomy(*parts, roots)
    found = from_taxonomy(records, keys)
    save_lookup(found, output)
    if as_json:
        export_lookup(found, f"{output}/lookup_json")
    stats = taxonomy_stats(records, keys, scope).first().asDict()
    return {**stats, "output": output, "bytes": total_bytes(spark, output)}
