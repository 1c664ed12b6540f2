"""Experiment trees: run parameters are carried by directory names."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.functions.units import last_path_part


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path) of files below `root` with a name like `pattern`; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )


def query_and_branch(path: Column) -> tuple[Column, Column]:
    """The two directories above an event log: root/<query>/<branch>/event_log."""
    tail = "([^/]+)/([^/]+)/event_log$"
    return F.regexp_extract(path, tail, 1), F.regexp_extract(path, tail, 2)


def experiment_tree(logs: DataFrame) -> DataFrame:
    """(path, query, branch) of the event logs in a tree."""
    query, branch = query_and_branch(F.col("path"))
    return logs.select("path", query.alias("query"), branch.alias("branch")).where(
        F.col("query") != ""
    )


def known_branches(tree: DataFrame, required: list[str]) -> DataFrame:
    """Logs of the wanted branches; `unknown_branches` has the others."""
    return tree.where(F.col("branch").isin(*required))


def unknown_branches(tree: DataFrame, required: list[str]) -> DataFrame:
    return tree.where(~F.col("branch").isin(*required))


def missing_branches(tree: DataFrame, required: list[str]) -> DataFrame:
    """(query, branch) pairs that a complete tree would have."""
    wanted = (
        tree.select("query")
        .distinct()
        .select("query", F.explode(F.array(*[F.lit(b) for b in required])).alias("branch"))
    )
    return wanted.join(tree.select("query", "branch"), ["query", "branch"], "left_anti")


def require_complete(tree: DataFrame, required: list[str]) -> DataFrame:
    """The wanted logs; an error that names one missing (query, branch) if there is any."""
    missing = missing_branches(tree, required).take(1)
    if missing:
        query, branch = missing[0]
        raise ValueError(f"no event log for branch {branch} of query {query}")
    return known_branches(tree, required)


def _token(directory: Column, position: int) -> Column:
    return F.try_element_at(F.split(directory, "_"), F.lit(position))


def sort_params(directory: Column) -> dict[str, Column]:
    """a_b_<num_tasks>_d_<order>_<num_shuffle_values>..., listed by descending order."""
    return {
        "num_tasks": _token(directory, 3).try_cast("bigint"),
        "order": _token(directory, 5).try_cast("bigint"),
        "num_shuffle_values": _token(directory, 6).try_cast("bigint"),
    }


def sweep_number(directory: Column) -> Column:
    """experiment_log_<number>_...: the number orders the experiments of a sweep."""
    return F.regexp_extract(directory, "experiment_log_([0-9]*)_", 1).try_cast("bigint")


def sweep_num_tasks(directory: Column) -> Column:
    """experiment_log_<workers>_<num_tasks>_..."""
    return F.regexp_extract(directory, "experiment_log_[0-9]*_([0-9]*)_", 1).try_cast("bigint")


def threads_per_disk(directory: Column) -> Column:
    """experiment_log_..._<threads>_<timestamp>"""
    return _token(directory, -2).try_cast("bigint")


def log_directory(path: Column) -> Column:
    """Name of the directory that holds a log file."""
    return last_path_part(F.regexp_replace(path, "/[^/]+$", ""))


def _sweep(directory: Column, _: Column) -> dict[str, Column]:
    return {"number": sweep_number(directory)}


def _systems(directory: Column, above: Column) -> dict[str, Column]:
    return {"system": above, "num_tasks": sweep_num_tasks(directory)}


def _disk(directory: Column, _: Column) -> dict[str, Column]:
    return {"threads": threads_per_disk(directory)}


def _benchmark(directory: Column, above: Column) -> dict[str, Column]:
    return {"query": F.lower(above), "branch": directory}


#: What a run's directory, and the one above it, say about the run, by kind of experiment.
KINDS = {
    "sort": lambda directory, _: sort_params(directory),
    "sweep": _sweep,
    "systems": _systems,
    "disk": _disk,
    "benchmark": _benchmark,
}


def run_params(runs: DataFrame, kind: str) -> DataFrame:
    """(app_id, parameters...) of the runs of an experiment: a small table to join reports with.

    `runs` has app_id, the directory of each run's log. A parameter that its name does not carry is
    NULL (`unnamed_runs`).
    """
    directory = last_path_part(F.col("app_id"))
    above = last_path_part(F.regexp_replace("app_id", "/[^/]*$", ""))
    params = KINDS[kind](directory, above)
    return runs.select("app_id").distinct().select(
        "app_id", *[column.alias(name) for name, column in params.items()]
    )


def unnamed_runs(params: DataFrame) -> DataFrame:
    """Runs whose directories do not carry all parameters."""
    carried = F.lit(True)
    for name in params.columns[1:]:
        carried = carried & F.col(name).isNotNull()
    return params.where(~carried)


def run_directories(spark: SparkSession, root: str, pattern: str = "event_log") -> DataFrame:
    """(app_id) of the runs below `root`: directories that hold an event log."""
    files = list_files(spark, root, pattern)
    return files.select(F.regexp_replace("path", "/[^/]+$", "").alias("app_id")).distinct()
