"""CSV files in, reports, changes and the grown catalog out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import catalog as C
from ..operators import decide
from ..sources import files
from . import mapping, report


def run(
    spark: SparkSession, ontology: str, tables: Sequence[str], out: str, answers: str | None = None, budget: int = V.BUDGET, mode: str = "auto", proposer: decide.Proposer = decide.propose,
) -> list[mapping.Mapped]:
    """Map the CSV files ``tables``, in order, onto the catalog in ``ontology`` and write what came of it below ``out``.

    For each file ``<n>_<name>.patch.json``, ``.report.json``, ``.report.md`` and ``.transcript.txt``; for all ``final_ontology.json`` and ``run_summary.json``.
    Each is a folder with one part, as Spark writes them.
    """
    read = [(path.rsplit("/", 1)[-1], files.read_csv(spark, path)) for path in tables]
    done = mapping.run(spark, C.read(spark, ontology), read, files.read_answers(spark, answers), budget, mode, proposer)
    for i, (m, path) in enumerate(zip(done, tables), 1):
        name = f"{out.rstrip('/')}/{files.stem(path, i)}"
        rows = m.profile.agg(F.max("row_count")).first()[0] or 0
        for kind, text in (("patch.json", report.patch_json(m)), ("report.json", report.report_json(m, rows)), ("report.md", report.markdown(m, rows)), ("transcript.txt", report.transcript(m))):
            files.write_text(text, f"{name}.{kind}")
    if done:
        files.write_json(C.nest(done[-1].catalog), f"{out.rstrip('/')}/final_ontology.json")
        files.write_json(report.summary(done), f"{out.rstrip('/')}/run_summary.json")
    return done


def projected(runs: Sequence[mapping.Mapped]) -> DataFrame:
    """``table, row, id, type, attributes, relationships`` of all rows shown, maps as JSON."""
    found = [m.entities.select(F.lit(m.name).alias("table"), "row", "id", "type", *(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c) for c in ("attributes", "relationships"))) for m in runs]
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole
