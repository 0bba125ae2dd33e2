"""One complete run: status, discovery, comparison with the last run, storage."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.functions.frames import metadata_frame
from keylink.operators.results import (
    relation_status,
    replace_relations,
    result_rows,
    run_summary,
)
from keylink.params import Params
from keylink.plans.discover import discover
from keylink.sources.catalog import Source
from keylink.sources.store import DONE, FAILED, RUNNING, ResultStore
from keylink.sources.workspace import Workspace


def run_model(
    spark: SparkSession,
    source: Source,
    store: ResultStore,
    params: Params,
    algorithm_name: str = "",
    execute_obj: str = "",
    now: datetime | None = None,
    **discover_options,
) -> DataFrame:
    """Discovers, stores and returns the relations of one model.

    A run that finds nothing still replaces the old automatic rows and closes
    its status; a run that fails is marked ``failed`` and changes no results.
    If another run of the model commits in between, the found relations are
    compared with its results and written again.
    """
    model = params.model_id
    started = now or datetime.now()
    run = store.claim_run(model)
    about = {"algorithm_name": algorithm_name, "execute_obj": execute_obj, "start_time": started}
    store.append_status(model, run, RUNNING, **about)
    try:
        workspace = Workspace(spark)
        found = discover(spark, source, params, workspace, **discover_options)
        rows = workspace.save(
            result_rows(found, F.lit(started).cast("timestamp")), "relations"
        )
        models = metadata_frame(spark, [(model,)], "model string")
        while True:
            version, last = store.version(model)
            previous = store.previous(model, last)
            current = workspace.save(relation_status(rows, previous), "compared")
            store.write_results(replace_relations(previous, current, models), run)
            if store.commit(model, run, version):
                break
            # Rows that no version names are never read; the next try has its own number.
            store.append_status(model, run, FAILED, **about, end_time=now or datetime.now())
            run = store.claim_run(model)
            store.append_status(model, run, RUNNING, **about)
        counts = run_summary(current).first()
        store.append_status(
            model,
            run,
            DONE,
            **about,
            end_time=now or datetime.now(),
            relation_num=counts["relation_num"] if counts else 0,
            new_relation_num=counts["new_relation_num"] if counts else 0,
        )
        return current
    except Exception:
        store.append_status(model, run, FAILED, **about, end_time=now or datetime.now())
        raise
